"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared checkpoint folder and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, packing, resemblance, substring_dedup
from tessera.llm.blocks import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if less than this share of its letters is in its main language.
MIN_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts with no main language.

    It learns from the labels of its own input; where none is labelled, only texts without letters go. Letters of scripts that no
    learned language uses count for none, so texts of such letters alone go. Null and empty texts go; ids may repeat or be null.
    """
    model = language.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.identify(docs.select(*COLUMNS), model, keep_text=True)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each group of near copies: a chain of links of 0.8 or more between sets of five-word shingles.

    Candidates are fingerprints' classes by tables of distances to references, and bands for the links beyond; all are verified exactly.

    Rows are told apart by where they lie, so a repeated doc_id costs no text that copies nothing; of equal ids in a group any
    one stays. Rows without an id are kept as they are. Texts without words, null ones too, are copies of each other. Columns beyond
    those of documents go; an empty table stays empty.
    """
    return resemblance.first_copies(docs.select(*COLUMNS))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes that a document of a smaller doc_id has in a string of 50; every row stays.

    A null text stays null; rows without an id keep theirs; rows that share an id cut nothing from each other. ``n_chars`` is counted anew.
    """
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS), replace=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or all words of a shorter one. Null texts hold none and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(*COLUMNS), benchmark, keep_text=True).where(~F.col("contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null text is its end token alone, and a null or repeated id is a document like others."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("benchmark_leaks", remove_benchmark_leaks),
    ("packing", pack_sequences),
]
#: Near copies and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

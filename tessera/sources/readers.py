"""Scans. Parquet and delimited tables, text lines, adjacency lists, labelled documents, models, streams of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.schemas import TABLE_SCHEMAS


def load(spark: SparkSession, base: str, table: str, fmt: str = "parquet") -> DataFrame:
    """One relational table: ``<base>/<table>.parquet``, or ``<base>/<table>.tbl`` with ``|`` between fields for fmt='text'."""
    if fmt == "parquet":
        return spark.read.parquet(f"{base}/{table}.parquet")
    if fmt == "text":
        return spark.read.schema(TABLE_SCHEMAS[table]).option("sep", "|").option("mode", "FAILFAST").csv(f"{base}/{table}.tbl")
    raise ValueError(f"unknown format {fmt!r}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (file, line_no, line); line_no counts from 0 within a file.

    Files are split like any other: a first pass counts the lines of each split, and running sums over these counts (one row a split)
    number the lines, which are not shuffled.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "at", (before - F.col("first")).alias("shift"))
    return rows.join(starts, ["file", "at"]).select("file", (F.col("n") + F.col("shift")).alias("line_no"), F.col("value").alias("line"))


def document_lines(documents: DataFrame) -> DataFrame:
    """A documents table as (doc_id, pos, line), one row a line; null texts have none."""
    return documents.where("text is not null").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))


def parse_adjacency(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id nbr nbr ...`` lines as (id, adj); a lone id is a dangling node; blank lines are dropped."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.where(F.length(F.trim(F.col(column))) > 0).select(
        parts[0].cast("bigint").alias("id"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<bigint>").alias("adj")
    )


def parse_labelled(lines: DataFrame, column: str = "value") -> DataFrame:
    """``docid label f1 f2 ...`` lines as (docid, label, features)."""
    parts = F.split(F.col(column), " +")
    return lines.select(
        parts[0].alias("docid"), parts[1].alias("label"), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))).cast("array<int>").alias("features")
    )


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """``(feature,weight)`` text files named ``part-*`` as (model_id, feature, weight); each file is one model."""
    lines = spark.read.option("pathGlobFilter", "part-*").text(path).select("value", F.col("_metadata.file_name").alias("model_id"))
    pair = F.split(F.regexp_replace("value", r"[()\s]", ""), ",")
    return lines.where(F.length("value") > 0).select("model_id", pair[0].cast("int").alias("feature"), pair[1].cast("double").alias("weight"))


def parse_trips(lines: DataFrame, column: str = "value") -> DataFrame:
    """Taxi CSV lines as (taxi, lon, lat): dropoff at fields 8 and 9 for 'green', else at 10 and 11."""
    f = F.split(F.col(column), ",")
    green = f[0] == "green"
    return lines.withColumns(
        {"taxi": f[0], "lon": F.when(green, F.get(f, F.lit(8))).otherwise(F.get(f, F.lit(10))).cast("double"), "lat": F.when(green, F.get(f, F.lit(9))).otherwise(F.get(f, F.lit(11))).cast("double")}
    )


def stream_text(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over ``part-*`` text files, so many a micro-batch, with the file's name."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "part-*")
    return reader.load(path).select("value", F.col("_metadata.file_name").alias("file"))

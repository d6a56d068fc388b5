"""Command line: ``python -m tessera COMMAND --input ... --output ...``; ``python -m tessera run NAME`` runs a registered query."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify, cooccurrence, graph, relational, retrieval, text
from tessera.operators.checkpoints import cut
from tessera.sources import readers, writers
from tessera.streaming import sinks, windows

Args = argparse.Namespace


def _lines(spark: SparkSession, a: Args) -> DataFrame:
    return spark.read.text(a.input).withColumnRenamed("value", "line")


def _docs(spark: SparkSession, a: Args) -> DataFrame:
    """Each line a document, numbered over all files in the order of their names."""
    found = readers.read_lines(spark, a.collection if "collection" in a else a.input)
    counts = found.groupBy("file").agg(F.count("*").alias("n"))
    order = counts.select("file", F.sum("n").over(_by_file()).alias("upto"), "n")
    return found.join(order, "file").select((F.col("upto") - F.col("n") + F.col("line_no")).alias("doc"), F.col("line").alias("text"))


def _by_file():
    from pyspark.sql import Window

    return Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _nodes(spark: SparkSession, a: Args) -> DataFrame:
    return readers.parse_adjacency(spark.read.text(a.input))


def _ints(value: str) -> list[int]:
    return [int(x) for x in value.split(",") if x]


def _stripes(df: DataFrame) -> DataFrame:
    return df.select("x", F.to_json("stripe").alias("stripe"))


def _rank(spark: SparkSession, a: Args) -> DataFrame:
    if a.sources:
        return graph.personalized_pagerank(_nodes(spark, a), a.sources, a.iterations, a.jump, a.tolerance)
    return graph.pagerank(_nodes(spark, a), a.iterations, a.jump, a.tolerance)


def _train(spark: SparkSession, a: Args) -> DataFrame:
    docs = readers.parse_labelled(spark.read.text(a.input))
    return classify.train(classify.shuffled(docs) if a.shuffle else docs.withColumn("position", F.col("docid")))


def _index(spark: SparkSession, a: Args) -> None:
    retrieval.stored_index(_docs(spark, a), a.output, a.reducers)


def _query(spark: SparkSession, a: Args) -> DataFrame:
    hits = retrieval.boolean_query(retrieval.open_index(spark, a.index), a.query)
    return retrieval.fetch_lines(hits, _docs(spark, a)).orderBy("doc")


def _events(spark: SparkSession, a: Args) -> DataFrame:
    """Taxi lines as a stream; the time of an event is that of its file's last change."""
    trips = readers.parse_trips(readers.stream_text(spark, a.input).withColumn("ts", F.col("_metadata.file_modification_time")))
    return windows.region_events(trips, windows.REGIONS)


def _relational(name: str) -> Callable[[SparkSession, Args], DataFrame]:
    tables = {
        "q1": (relational.shipped_count, ("lineitem",)), "q2": (relational.shipped_clerks, ("lineitem", "orders")), "q3": (relational.shipped_parts, ("lineitem", "part", "supplier")),
        "q4": (relational.shipped_by_nation, ("lineitem", "orders", "customer", "nation")), "q5": (relational.monthly_by_nation, ("lineitem", "orders", "customer", "nation")),
        "q6": (relational.pricing_summary, ("lineitem",)), "q7": (relational.unshipped_orders, ("lineitem", "orders", "customer")),
    }
    f, needed = tables[name]
    return lambda spark, a: f(*[readers.load(spark, a.input, t, "text" if a.text else "parquet") for t in needed], *([] if name == "q5" else [a.date]))


COMMANDS: dict[str, Callable[[SparkSession, Args], DataFrame | None]] = {
    "word-count": lambda spark, a: text.word_count(_lines(spark, a)),
    "followers": lambda spark, a: text.follower_count(_lines(spark, a), a.word),
    "bigrams": lambda spark, a: text.bigram_count(_lines(spark, a)),
    "relative-frequency": lambda spark, a: _stripes(text.relative_frequency_stripes(_lines(spark, a))) if a.stripes else text.relative_frequency_pairs(_lines(spark, a)),
    "pmi-pairs": lambda spark, a: cooccurrence.sorted_pairs(cooccurrence.pmi_pairs(_lines(spark, a), a.threshold)),
    "pmi-stripes": lambda spark, a: _stripes(cooccurrence.pmi_stripes(_lines(spark, a), a.threshold)),
    "index": _index,
    "query": _query,
    "pagerank": lambda spark, a: _rank(spark, a).select("id", "p"),
    "top-nodes": lambda spark, a: graph.top_nodes(_rank(spark, a), a.top).select("id", F.format_string("%.5f", "p").alias("p")),
    "rank-order": lambda spark, a: graph.ranked_order(_rank(spark, a)),
    "dump-nodes": lambda spark, a: graph.dump_nodes(graph.build_ranked_nodes(_nodes(spark, a), a.sources or None)),
    "counters": lambda spark, a: graph.graph_counters(_nodes(spark, a)),
    "components": lambda spark, a: graph.weak_components(_nodes(spark, a)),
    "train": _train,
    "apply": lambda spark, a: classify.apply_model(readers.parse_labelled(spark.read.text(a.input)), cut(readers.read_models(spark, a.model))),
    "ensemble": lambda spark, a: classify.apply_ensemble(readers.parse_labelled(spark.read.text(a.input)), cut(readers.read_models(spark, a.model)), a.method),
    "regions": lambda spark, a: sinks.drain_updates(windows.windowed_counts(_events(spark, a), "60 minutes"), "regions", ["window_end", "key"]),
    **{f"q{k}": _relational(f"q{k}") for k in range(1, 8)},
    "run": lambda spark, a: __import__("tessera.plans.registry", fromlist=["QUERIES"]).QUERIES[a.name](spark, a.input),
}
#: Commands whose rows are written as ``(a,b,...)`` lines, which the reader of models takes.
TUPLES = ("train",)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("name", nargs="?", help="of a registered query, for run")
    p.add_argument("--input", help="a text file or folder; for q1 to q7 and run a folder of tables")
    p.add_argument("--output", help="a folder to write; rows are shown without it")
    p.add_argument("--reducers", type=int, help="partitions of shuffles")
    p.add_argument("--threshold", type=int, default=1)
    p.add_argument("--stripes", action="store_true")
    p.add_argument("--word", default="perfect")
    p.add_argument("--index", help="a stored index")
    p.add_argument("--collection", default=argparse.SUPPRESS, help="the indexed text")
    p.add_argument("--query", help="in reverse Polish notation")
    p.add_argument("--sources", type=_ints, default=[])
    p.add_argument("--iterations", type=int, default=10)
    p.add_argument("--jump", type=float, default=graph.ALPHA)
    p.add_argument("--tolerance", type=float)
    p.add_argument("--top", type=int, default=100)
    p.add_argument("--model", help="a folder of models, or where to write one")
    p.add_argument("--shuffle", action="store_true")
    p.add_argument("--method", choices=("average", "vote"), default="average")
    p.add_argument("--date", default="1998-08-23")
    form = p.add_mutually_exclusive_group()
    form.add_argument("--text", action="store_true")
    form.add_argument("--parquet", action="store_true")
    p.add_argument("--checkpoint", help="the folder that driver and executors share")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Run a command; its rows are written, or shown and returned."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tessera {a.command}").getOrCreate()
    if a.checkpoint:
        spark.sparkContext.setCheckpointDir(a.checkpoint)
    if a.reducers:
        spark.conf.set("spark.sql.shuffle.partitions", a.reducers)
    rows = COMMANDS[a.command](spark, a)
    output = a.model if a.command == "train" else a.output
    if rows is None:
        return None
    if not output:
        rows.show(truncate=False)
        return rows
    (writers.write_tuples if a.command in TUPLES else writers.write_tsv)(rows, output)
    return spark.read.text(output)


if __name__ == "__main__":
    main()

"""Sinks. All of them replace what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text."""
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_tuples(df: DataFrame, path: str) -> None:
    """One ``(a,b,...)`` line a row."""
    body = F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])
    df.select(F.concat(F.lit("("), body, F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def write_keyed(df: DataFrame, path: str, key: str | list[str], partitions: int) -> None:
    """Parquet dealt by the key's columns and sorted by it in each file, so that row-group statistics prune point lookups."""
    keys = [key] if isinstance(key, str) else key
    df.repartition(partitions, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Graph records as text: ``{id rank [first ten neighbours]}``."""
    from tessera.operators.graph import dump_nodes

    dump_nodes(nodes).select(F.col("record").alias("value")).write.mode("overwrite").text(path)

"""Gap coding of ascending postings lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode_gaps(postings: Column) -> Column:
    """array<struct<doc,tf>> ascending by doc -> array<struct<gap,tf>>; the first gap is the doc id itself."""
    previous = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(postings, lambda p: p["doc"]))
    return F.zip_with(
        postings,
        F.slice(previous, F.lit(1), F.size(postings)),
        lambda p, before: F.struct((p["doc"] - before).alias("gap"), p["tf"].alias("tf")),
    )


def decode_gaps(lists: DataFrame, keys: list[str], postings: str = "postings") -> DataFrame:
    """(keys, doc, tf): the inverse of :func:`encode_gaps`, a running sum over each list; ``keys`` name a list."""
    placed = lists.select(*keys, F.posexplode(postings).alias("__at", "p"))
    doc = F.sum("p.gap").over(Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.select(*keys, doc.cast("bigint").alias("doc"), "p.tf")

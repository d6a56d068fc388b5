"""Tumbling windows over a table of (ts, key).

Once a key was seen it is reported for every later window, with 0 where nothing arrived; the twins below share
that rule. A trend compares a window with the one right before it (0 if that was empty), not the last non-empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from tessera.functions.geo import REGIONS, Box, region_label


def region_events(points: DataFrame, regions: dict[str, Box] = REGIONS, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points inside a region, keyed by its name; others go."""
    return points.withColumn("key", region_label(F.col(x), F.col(y), regions)).where("key is not null")


def windowed_counts(events: DataFrame, width: str) -> DataFrame:
    """(window_end, key, n) for non-empty windows; runs on streams (set a watermark first) and tables."""
    return events.groupBy(F.window("ts", width).alias("w"), "key").agg(F.count("*").alias("n")).select(F.col("w.end").alias("window_end"), "key", "n")


def zero_filled(counts: DataFrame, width: str) -> DataFrame:
    """(window_end, key, n) with the empty windows of each key, from its first window to the table's last."""
    last = counts.agg(F.max("window_end")).scalar()
    seen = counts.groupBy("key").agg(F.min("window_end").alias("first"))
    spine = seen.select("key", F.explode(F.sequence("first", last, F.expr(f"INTERVAL {width}"))).alias("window_end"))
    return spine.join(counts, ["key", "window_end"], "left").select("window_end", "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def hourly_counts(events: DataFrame, width: str = "60 MINUTES") -> DataFrame:
    """Batch twin of the hourly stream: zero-filled counts."""
    return zero_filled(windowed_counts(events, width), width)


def trends(events: DataFrame, width: str = "10 MINUTES", threshold: int = 10) -> DataFrame:
    """(window_end, key, n, prev): windows of at least ``threshold`` events and at least twice the window before.

    Empty windows never alert, so no spine is needed: the previous row counts only if it ends where this one starts.
    """
    order = Window.partitionBy("key").orderBy("window_end")
    counts = windowed_counts(events, width)
    adjacent = F.lag("window_end").over(order) == F.col("window_end") - F.expr(f"INTERVAL {width}")
    with_prev = counts.withColumn("prev", F.when(adjacent, F.lag("n").over(order)).otherwise(F.lit(0)).cast("bigint"))
    return with_prev.where((F.col("n") >= threshold) & (F.col("n") >= 2 * F.col("prev")))


class PreviousWindow(StatefulProcessor):
    """Keeps the last window's end and count of a key, and emits each window with the count of the one right before."""

    def __init__(self, width_seconds: int) -> None:
        self.width = pd.Timedelta(seconds=width_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("window_end", TimestampType()), StructField("n", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("window_end")
        before, count = (pd.Timestamp(v) if i == 0 else v for i, v in enumerate(self.last.get())) if self.last.exists() else (None, 0)
        out = []
        for end, n in zip(found["window_end"], found["n"], strict=True):
            end = pd.Timestamp(end)
            naive = end.tz_localize(None) if end.tzinfo else end
            prev = int(count) if before is not None and before + self.width == naive else 0
            out.append((end, key[0], int(n), prev))
            before, count = naive, int(n)
        self.last.update((before.to_pydatetime(), count))
        yield pd.DataFrame(out, columns=["window_end", "key", "n", "prev"])

    def close(self) -> None:
        pass


def stream_windowed_counts(events: DataFrame, width: str, delay: str = "0 seconds") -> DataFrame:
    """Streaming (window_end, key, n) in append mode: a window comes out once the watermark has passed it."""
    return windowed_counts(events.withWatermark("ts", delay), width)


def trend_alerts(batch: DataFrame, threshold: int) -> DataFrame:
    """Alerts among rows of (window_end, key, n, prev)."""
    return batch.where((F.col("n") >= threshold) & (F.col("n") >= 2 * F.col("prev")))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own choice is restored afterwards."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_trends(counts: DataFrame, width_seconds: int) -> DataFrame:
    """Streaming (window_end, key, n, prev) from a stream of window counts, by keyed state. Needs the RocksDB state store, see :func:`keyed_state`."""
    return counts.groupBy("key").transformWithStateInPandas(
        statefulProcessor=PreviousWindow(width_seconds),
        outputStructType="window_end timestamp, key string, n bigint, prev bigint",
        outputMode="append",
        timeMode="None",
    )

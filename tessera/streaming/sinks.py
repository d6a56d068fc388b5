"""Runs that drain what is there, then stop."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import checkpoint_dir


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Write the stream to Parquet in the shared checkpoint folder until its input is used up; return the rows.

    The offsets log lies beside them, so a run that lost an executor resumes, and each window is written once.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/rows").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def batch_path(base: str, number: int) -> str:
    """Where a micro-batch's rows go: ``part-`` and its number, in eight digits."""
    return f"{base}/part-{number:08d}"


def each_batch(stream: DataFrame, base: str, write: Callable[[DataFrame, str], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Hand each micro-batch to ``write`` with a path of its own under ``base``, until the input is used up.

    A batch that runs again after a failure gets the same path; ``write`` should replace what is there.
    """
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}-log").trigger(availableNow=True)
    run.foreachBatch(lambda batch, number: write(batch, batch_path(base, number))).start().awaitTermination()


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The last state of each key of an aggregate, once the input is used up.

    Each micro-batch writes only the rows it changed, and the watermark, if the stream has one, lets state go; the last row of a key wins.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    each_batch(stream, base, lambda batch, path: batch.write.mode("overwrite").parquet(path), mode="update")
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(base)
    batch = F.regexp_extract("_metadata.file_path", r"/part-(\d{8,})/", 1).cast("bigint")
    last = rows.withColumn("__batch", batch).groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "__batch").alias("row"))
    return last.select("row.*")

"""Reliable lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the session names one, else the folder given to ``setCheckpointDir``.

    Where neither is set, a local master, as in tests, gets a temporary folder; on a cluster that is an error, as no path is known
    to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed now and read back from shared files, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Like :func:`cut`, dealt by ``key``: a bucketed table, which later joins and aggregates on the key need not shuffle."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions, key).option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)

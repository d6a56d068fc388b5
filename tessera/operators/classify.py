"""Online logistic classification over sparse binary features, and ensembles of models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokenize

DELTA = 0.002
#: Rows of a block in training.
BLOCK = 1000


def feature_rows(docs: DataFrame) -> DataFrame:
    """(docid, feature): distinct tokens of ``text`` as the first 28 bits of their MD5, one row each."""
    words = docs.select("docid", F.explode_outer(F.array_distinct(tokenize(F.col("text")))).alias("w")).where("w is not null")
    return words.select("docid", F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("int").alias("feature"))


def hashed_features(docs: DataFrame) -> DataFrame:
    """(docid, features): the features of each text as an array; texts without a token have none."""
    found = feature_rows(docs).groupBy("docid").agg(F.sort_array(F.collect_list("feature")).alias("features"))
    return docs.select("docid").join(found, "docid", "left").select("docid", F.coalesce("features", F.array().cast("array<int>")).alias("features"))


def shuffled(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Training rows with a seeded random ``position``."""
    return docs.withColumn("position", F.md5(F.concat(F.lit(f"{seed}:"), F.col("docid").cast("string"))))


def _stepped(known: np.ndarray, weights: np.ndarray, labels: pa.Array, features: pa.Array, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """The features known, ascending, and their weights after one step for each row; the rows' own weights are held together meanwhile."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False)).tolist()
    own, at = np.unique(features.flatten().to_numpy(), return_inverse=True)
    place = np.searchsorted(known, own)
    old = np.append(known, 0)[place] == own if len(own) else np.zeros(0, bool)
    old &= place < len(known)
    w = np.zeros(len(own))
    w[old] = weights[place[old]]
    start = 0
    for label, end in zip(labels.to_pylist(), ends, strict=True):
        held, start = at[start:end], end
        step = ((1.0 if label == "spam" else 0.0) - 1.0 / (1.0 + math.exp(-float(w[held].sum())))) * delta
        np.add.at(w, held, step)
    weights[place[old]] = w[old]
    return np.insert(known, place[~old], own[~old]), np.insert(weights, place[~old], w[~old])


def train(docs: DataFrame, position: str = "position", delta: float = DELTA) -> DataFrame:
    """(feature, weight) by one pass of stochastic gradient descent in ascending ``position`` (then docid).

    Each update depends on the one before, so the pass is sequential by definition. All executors sort the rows and pack them, in
    order, to numbered blocks; one task merges the blocks by number (a sort of few, large rows) and holds the weights alone, as two arrays.
    Features are not null.
    """
    ordered = docs.select("docid", "label", "features", position).orderBy(position, "docid").select("label", "features")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        slices = (batch.slice(at, BLOCK) for batch in batches for at in range(0, len(batch), BLOCK))
        for k, some in enumerate(slices):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema) as out:
                out.write_batch(some)
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "k": pa.array([k], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = np.empty(0, np.int32), np.empty(0)
        for batch in batches:
            for block in batch.column("rows"):
                with pa.ipc.open_stream(block.as_buffer()) as rows:
                    for part in rows:
                        known, weights = _stepped(known, weights, part.column(0), part.column(1), delta)
        for at in range(0, len(known), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(known[at : at + 100_000]), pa.array(weights[at : at + 100_000])], names=["feature", "weight"])

    blocks = ordered.mapInArrow(packed, "task int, k int, rows binary")
    return blocks.repartition(1).sortWithinPartitions("task", "k").mapInArrow(descend, "feature int, weight double")


def _rows(docs: DataFrame) -> DataFrame:
    """(docid, feature) from a table with either ``feature`` rows or ``features`` arrays."""
    return docs.select("docid", "feature") if "feature" in docs.columns else docs.select("docid", F.explode_outer("features").alias("feature")).where("feature is not null")


def score(docs: DataFrame, models: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(docid, model_id, score): for every model the summed weight of each feature occurrence; unknown features add nothing.

    ``docs`` holds ``features`` arrays, or ``feature`` rows with the documents' ids apart in ``ids``.
    """
    names = models.select("model_id").distinct()
    sums = _rows(docs).join(models, "feature").groupBy("docid", "model_id").agg(F.sum("weight").alias("s"))
    every = (docs if ids is None else ids).select("docid").withColumn("model_id", F.explode(names.agg(F.collect_list("model_id")).scalar()))
    return every.join(sums, ["docid", "model_id"], "left").select("docid", "model_id", F.coalesce("s", F.lit(0.0)).alias("score"))


def apply_model(docs: DataFrame, model: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(docid, score, predicted) by one model (feature, weight); an empty model scores 0. ``docs`` and ``ids`` as in :func:`score`."""
    sums = _rows(docs).join(model.select("feature", "weight"), "feature").groupBy("docid").agg(F.sum("weight").alias("s"))
    scored = (docs if ids is None else ids).select("docid").join(sums, "docid", "left").select("docid", F.coalesce("s", F.lit(0.0)).alias("score"))
    return scored.select("docid", "score", _predicted("score"))


def _predicted(column: str):
    return F.when(F.col(column) > 0, "spam").otherwise("ham").alias("predicted")


def apply_ensemble(docs: DataFrame, models: DataFrame, method: str = "average", ids: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(docid, score, predicted): the mean of the models' scores, or with any other method their votes (a tie is ham).

    With ``digits`` a model votes on its score rounded to so many: weights that cancel out sum to zero only up to the order of adding.
    """
    voted = F.col("score") if digits is None else F.round("score", digits)
    value = F.avg("score") if method == "average" else F.sum(F.when(voted > 0, 1.0).otherwise(-1.0))
    return score(docs, models, ids).groupBy("docid").agg(value.alias("score")).select("docid", "score", _predicted("score"))

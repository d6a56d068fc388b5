"""Nearest neighbours by a permutation index.

A vector is represented by the pivots nearest to it, in order. Segments of vectors are posted in inverted files: for
each pivot, the vectors that have it among their first ``PREFIX``, with its place. A query adds up, over the lists of its own
first ``ASKED`` pivots, how far each vector's places are from its own (Spearman's footrule on prefixes, a missing pivot counting
as just behind the last); the vectors of least distance, with all that tie with the last of them, are then ranked by exact inner
products in double precision.

Equal vectors of a segment are posted once, with all their ids, so copies take no places from other vectors.
Footrule tells angles alone. Where norms differ, a segment learns from some of its own vectors which cosine a distance stands for, and
a query reranks the vectors whose expected cosine is farthest above what their norm requires to be among the nearest.

Pivots are a sample of at most ``PIVOTS`` distinct vectors, those of least hashed id. Inverted files are kept by segment, not dealt by
pivot: with vectors as evenly spread as those of the given tables a fixed number of candidates finds few neighbours (recall 0.5
with 500 of 51,282), so a share of all is reranked, and partial sums of that many would have to be shuffled. Each segment is
searched by each block of queries; a segment returns its best ``k + 1`` to a final merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import materialize, tidy

PIVOTS, PREFIX, ASKED, SEGMENT, QUERIES = 2048, 32, 128, 16384, 1024
#: Of a segment this share is reranked, and besides this many times ``k``.
RERANK, SPARE = 0.05, 5
#: Vectors of a segment by which it learns what cosine a footrule distance stands for.
FITTED = 32


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): doubles, without null, empty, zero or non-finite vectors; null ids are out as well. Lengths may differ."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, by angle, nearest first."""
    near = -(vectors @ pivots.T)
    prefix = min(prefix, len(pivots))
    first = np.argpartition(near, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(first, np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1)


class Segment:
    """Vectors with their pivots' inverted files."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int, asked: int) -> None:
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, group.ravel()))
        self.ids = ids[order]
        self.starts = np.searchsorted(group.ravel()[order], np.arange(len(self.vectors) + 1))
        ranks = permutations(self.vectors, pivots, prefix)
        own, self.asked = ranks.shape[1], min(asked, len(pivots))
        row, place = np.divmod(np.arange(ranks.size), own)
        order = np.argsort(ranks.ravel(), kind="stable")
        self.rows, self.places = row[order], place[order]
        p, q = np.arange(own)[None, :], np.arange(self.asked)[:, None]
        #: How much nearer a shared pivot brings, by its places in the query and in the vector.
        self.gains = (2 * self.asked - p - q - np.abs(p - q)).astype(np.float64)
        self.bounds = np.searchsorted(ranks.ravel()[order], np.arange(len(pivots) + 1))
        self.norms = np.linalg.norm(self.vectors, axis=1)
        #: Where norms are equal but for rounding, cosines alone tell.
        self.uneven = self.norms.max(initial=0) > (1 + 1e-5) * self.norms.min(initial=np.inf)
        self.base, self.slope = self._fit(pivots) if self.uneven else (0.0, 1.0)

    def _fit(self, pivots: np.ndarray) -> tuple[float, float]:
        """The line of least squares from nearness to cosines, over a few of the vectors as queries and all as candidates."""
        few = np.linspace(0, len(self.vectors) - 1, min(FITTED, len(self.vectors))).astype(np.int64)
        gains = np.stack([self.nearness(r) for r in permutations(self.vectors[few], pivots, self.asked)])
        cosines = (self.vectors[few] @ self.vectors.T) / np.outer(self.norms[few], self.norms)
        gains, cosines = (x[np.arange(len(self.vectors)) != few[:, None]] for x in (gains, cosines))
        spread = ((gains - gains.mean()) ** 2).sum() if len(gains) else 0.0
        if not spread:
            return 0.0, 1.0
        slope = float(((gains - gains.mean()) * cosines).sum() / spread)
        return (float(cosines.mean() - slope * gains.mean()), slope) if slope > 0 else (0.0, 1.0)

    def nearness(self, permutation: np.ndarray) -> np.ndarray:
        """What all vectors' footrule distances to the query's prefix lack to that of a vector that shares no pivot."""
        lo, n = self.bounds[permutation], self.bounds[permutation + 1] - self.bounds[permutation]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.rows[at], self.gains[np.repeat(np.arange(len(permutation)), n), self.places[at]], len(self.vectors))

    def search(self, q: np.ndarray, q_ranks: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, scores, whether the vector equals the query) for each query: the best ``k + 1`` of the vectors of least footrule distance, norms allowed for."""
        size = len(self.vectors)
        most = min(size, int(np.ceil(RERANK * size)) + SPARE * k)
        few = min(most, SPARE * k)
        held = np.minimum(np.diff(self.starts), k + 1)  # of a vector's ids the first are enough
        for n in range(len(q)):
            hope = self.nearness(q_ranks[n])
            if self.uneven:
                # The cosine that a vector needs is the last of a first few's k + 1 best scores over its norm; hope is how far it is expected above that.
                cosine = self.base + self.slope * hope
                first = np.argpartition(self.norms * cosine, size - few)[size - few :]
                last = np.sort(self.vectors[first] @ q[n])[-min(k + 1, few)] / np.linalg.norm(q[n])
                hope = cosine - max(0.0, last) / self.norms
            near = np.flatnonzero(hope >= np.partition(hope, size - most)[size - most])
            scores, count = exact(self.vectors[near], q[n]), held[near]
            same = (self.vectors[near] == q[n]).all(axis=1)
            at = np.repeat(self.starts[near] - np.cumsum(count) + count, count) + np.arange(count.sum())
            ids, scores, same = self.ids[at], np.repeat(scores, count), np.repeat(same, count)
            order = np.lexsort((ids, -scores))[: k + 1]
            yield ids[order], scores[order], same[order]


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each added up in the order of components, whatever else is in the batch."""
    return np.cumsum(vectors * q, axis=1)[:, -1] if len(vectors) else np.zeros(0)


def _blobs(df: DataFrame, rows: int, name: str) -> DataFrame:
    """(name, ids, vectors): so many rows in one, from each task."""

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        table = pa.Table.from_batches(batches, schema=pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))]))
        for start in range(0, len(table), rows):
            part = table.slice(start, rows).combine_chunks()
            vectors = part["v"].combine_chunks() if isinstance(part["v"], pa.ChunkedArray) else part["v"]
            m = _matrix(vectors)
            yield pa.RecordBatch.from_pydict({name: [base + k], "ids": [part["id"].to_numpy().astype(np.int64).tobytes()], "vectors": [m.tobytes()]})
            k += 1

    return df.mapInArrow(build, f"{name} bigint, ids binary, vectors binary")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, asked: int = ASKED
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, ties to the smaller id.

    Queries are rows of the same form; of the rows with a query's id and vector one, its own, is left out. Repeated rows are queries
    and candidates of their own. Vectors and queries that are null, empty, zero, not finite or not of the commonest length (of several
    the longest) take no part. Other columns are not read.
    """
    spark = vectors.sparkSession
    base = usable(vectors, key, vector)
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    lengths = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], shape)
    dim, count = lengths[0]
    base = base.where(F.size("v") == dim)
    sample = base.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    centres = np.array([r["v"] for r in sample])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(centres)
    per = count // SEGMENT + 1
    segments = materialize(_blobs(base.repartition(per, F.xxhash64("id")), SEGMENT, "segment"), "segments")
    blocks = _blobs(usable(queries, key, vector).where(F.size("v") == dim).repartition(per, F.xxhash64("id")), QUERIES, "block")
    paired = blocks.select("block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q")).withColumn("segment", F.explode(segments.agg(F.collect_list("segment")).scalar())).join(segments, "segment")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, segment = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["segment"] != last:
                    last = r["segment"]
                    segment = Segment(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, dim), shared.value, prefix, asked)
                q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q"]).reshape(-1, dim)
                ids, scores, same = zip(*segment.search(q, permutations(q, shared.value, asked), k), strict=True)
                sizes = [len(i) for i in ids]
                number = np.repeat(np.arange(len(q)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(number), r["block"])), pa.array(number), pa.array(q_ids[number]), *(pa.array(np.concatenate(x)) for x in (ids, scores, same))],
                    ["block", "number", "query_id", "vec_id", "score", "same"],
                )

    best = paired.select("segment", "block", "q_ids", "q", "ids", "vectors").mapInArrow(run, "block bigint, number bigint, query_id bigint, vec_id bigint, score double, same boolean")
    order = Window.partitionBy("block", "number").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    few = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    mine = F.col("same") & (F.col("vec_id") == F.col("query_id"))
    met = few.withColumn("mine", mine).withColumn("met", F.count_if("mine").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    other = met.where(~(F.col("mine") & (F.col("met") == 1)))
    return other.select("query_id", (F.col("place") - F.least("met", F.lit(1))).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

"""Near copies by resemblance: the Jaccard index of texts' sets of word shingles, computed exactly.

A text's shingles are 64-bit hashes of its runs of ``SHINGLE`` lower-cased words (of all its words if it has fewer).
Texts of equal sets are one vertex. Candidates are vertices whose SimHash fingerprints, over their sets, are joined by
wide links (``simhash``: postings, and tables of distances to references): each such class is a group, and all links in
it are found. Pairs at 0.8 differ in about 10 of 64 bits and often in more, and postings that cover that many hold most
pairs. So for the rest there are bands of minima: vertices that share all ``ROWS`` minima of one of ``BANDS`` bands are a
group too, unless they all are of one class. Two sets of resemblance s that no wide link joins miss each other with
probability (1 - s^ROWS)^BANDS, 3e-5 at 0.8 and less above.

Groups of equal members are looked at once. First the set of a group's leader goes to the blocks of its members, which count how alike they are to it: that links whoever resembles
the leader. As 1 - resemblance is a metric, a link that remains has an end that does not resemble the leader, and
ends whose distances to the leader differ by at most 1 - ``SIMILARITY``; so only members that can be such ends are
dealt on, in cells of that distance, and a group of copies like their leader is never gathered. A cell's sets meet in
one task, where resemblances are counted over an inverted index of shingles, members that are linked already are not
compared again, and a spanning forest of the links comes out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.blocks import materialize, partitions_of, tidy, unpack, write_blocks
from tessera.llm.simhash import _LOWER, SEED, majority, wide_components
from tessera.operators.checkpoints import cut
from tessera.operators.graph import component_labels

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Smaller sets resemble no other one by ``SIMILARITY``, and have no fingerprint.
LEAST = 4
#: The width of a cell of distances to a leader, a little over what a link allows for rounding; blocks that one row of a leader's set serves.
WIDTH, LOT = 1 - SIMILARITY + 1e-9, 256
_FACTORS = np.random.default_rng(7).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(8).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes; none without words."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts, stops = (ends - sizes + 1)[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, stops, strict=True)), np.uint64, n))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its number and of the minima of its permutations. Empty sets have none."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 1 << 12):
            least = np.minimum(least, (own[k : k + (1 << 12), None] * _FACTORS + _SHIFTS).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


ROWS_OF = "block_id bigint, n int, id bigint, vertex bigint, keys array<bigint>, fp bigint"


def _vertices(text: str, key: str | None):
    """Blocks -> (block_id, n, id, vertex, keys, fp) of each row: its number in the block, its key, a hash of its shingle set, its bands' keys and its fingerprint."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = unpack(payload)
                rows = block.num_rows
                vertices, keys, fps = np.empty(rows, np.uint64), [], []
                for k in range(rows):
                    own = shingles(block.column(text)[k].as_py())
                    vertices[k] = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                    keys.append(band_keys(own))
                    fps.append(int(majority(own).view(np.int64)) if len(own) >= LEAST else None)
                ids = block.column(key).cast(pa.int64()) if key else pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, block_id)), pa.array(np.arange(rows, dtype=np.int32)), ids, pa.array(vertices.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())],
                    ["block_id", "n", "id", "vertex", "keys", "fp"],
                )

    return run


def _sets(text: str):
    """Blocks with the rows asked for -> (grp, vertex, shingles): a row's set for each of its groups."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, found = unpack(row["payload"]).column(text), {"grp": [], "vertex": [], "shingles": []}
                for r in row["asked"]:
                    own = shingles(texts[r["n"]].as_py()).tobytes()
                    found["grp"] += r["groups"]
                    found["vertex"] += [r["vertex"]] * len(r["groups"])
                    found["shingles"] += [own] * len(r["groups"])
                    if len(found["grp"]) > 2000:
                        yield pa.RecordBatch.from_pydict(found, schema=_SETS)
                        found = {c: [] for c in found}
                yield pa.RecordBatch.from_pydict(found, schema=_SETS)

    return run


_SETS = pa.schema([("grp", pa.int64()), ("vertex", pa.int64()), ("shingles", pa.binary())])


def forest(sets: Sequence[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of numbers of sets: a spanning forest of the links of resemblance ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    owner, held = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    component, links = np.arange(len(sets)), []
    for k, own in enumerate(sets[:-1]):
        other = component != component[k]
        if not other[k + 1 :].any():
            continue
        lo, hi = np.searchsorted(held, own), np.searchsorted(held, own, side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        near = other & (shared / (sizes + sizes[k] - shared) >= least)
        for j in np.flatnonzero(near).tolist():
            if component[j] != component[k]:
                links.append((k, j))
                component[component == component[j]] = component[k]
    return links


@tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, vertex, shingles), a group's in a row -> edges (a, b)."""
    now, vertices, sets = None, [], []

    def edges() -> pa.RecordBatch:
        found = forest(sets)
        return pa.RecordBatch.from_arrays([pa.array([vertices[i] for i, _ in found], pa.int64()), pa.array([vertices[j] for _, j in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for group, vertex, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if group != now:
                if len(sets) > 1:
                    yield edges()
                now, vertices, sets = group, [], []
            vertices.append(vertex)
            sets.append(np.frombuffer(own, np.uint64))
    if len(sets) > 1:
        yield edges()


def _to_leaders(text: str):
    """Blocks with leaders' sets and the rows asked for -> (grp, vertex, leader, likeness) for each of a row's groups."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = unpack(row["payload"]).column(text)
                sets = {r["leader"]: np.frombuffer(r["shingles"], np.uint64) for r in row["leaders"]}
                found, n, own = {c: [] for c in LIKENESS.names}, None, None
                for r in sorted(row["asked"], key=lambda r: r["n"]):
                    if r["n"] != n:
                        n, own = r["n"], shingles(texts[r["n"]].as_py())
                    other = sets[r["leader"]]
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    found["grp"] += r["groups"]
                    for c, v in (("vertex", r["vertex"]), ("leader", r["leader"]), ("likeness", shared / (len(own) + len(other) - shared))):
                        found[c] += [v] * len(r["groups"])
                yield pa.RecordBatch.from_pydict(found, schema=LIKENESS)

    return run


LIKENESS = pa.schema([("grp", pa.int64()), ("vertex", pa.int64()), ("leader", pa.int64()), ("likeness", pa.float64())])


def _candidates(vertices: DataFrame) -> DataFrame:
    """(key, vertex, part): a key for each class of wide links, whose vertices are parts of their own, and the bands' keys, with classes as parts."""
    own = vertices.select("vertex", "at.keys", "at.fp")
    classes = wide_components(own.select("fp").where("fp is not null").distinct())
    placed = own.join(classes, "fp", "left").withColumn("part", F.coalesce("component", "fp", "vertex"))
    near = placed.where("fp is not null").select(F.xxhash64(F.lit("class"), "part").alias("key"), "vertex", F.col("vertex").alias("part"))
    return placed.select(F.explode("keys").alias("key"), "vertex", "part").unionByName(near)


def _groups(keyed: DataFrame) -> DataFrame:
    """Distinct (key, vertex) and their parts -> (grp, vertex, leader): keys of several parts, one of the keys that have the same vertices; the leader is the smallest."""
    marks = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("vertex")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "vertex")).alias("y"), F.min("vertex").alias("leader"), F.min("part").alias("first"), F.max("part").alias("last")]
    once = keyed.groupBy("key").agg(*marks).where("first < last").groupBy("size", "x", "y").agg(F.min(F.struct("key", "leader")).alias("least")).select("least.key", "least.leader")
    return cut(keyed.join(once, "key").select(F.col("key").alias("grp"), "vertex", "leader"))


def _asked(blocks: DataFrame, asked: DataFrame, text: str, kind: str) -> DataFrame:
    """(vertex, at, groups) -> (grp, vertex, shingles)."""
    by_block = asked.groupBy("block_id").agg(F.collect_list(F.struct("n", "vertex", "groups")).alias("asked"))
    return blocks.join(by_block, "block_id").select("payload", "asked").mapInArrow(_sets(text), kind)


def _likeness(blocks: DataFrame, vertices: DataFrame, groups: DataFrame, text: str) -> DataFrame:
    """(grp, vertex, leader, likeness) of all members but the leaders.

    A block gets each set it needs once; a leader whom many blocks need is dealt out in several rows.
    """
    kind = "grp bigint, vertex bigint, shingles binary"
    leaders = groups.select(F.col("leader").alias("vertex")).distinct().join(vertices, "vertex").withColumn("groups", F.array("vertex"))
    sets = _asked(blocks, leaders, text, kind).select(F.col("vertex").alias("leader"), "shingles")
    asked = groups.where("vertex <> leader").groupBy("vertex", "leader").agg(F.collect_list("grp").alias("groups")).join(vertices, "vertex")
    need = cut(asked.select("block_id", "leader").distinct())
    parts = need.groupBy("leader").agg(F.ceil(F.count("*") / LOT).cast("int").alias("parts"))
    dealt = sets.join(parts, "leader").select("leader", "shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asking = need.join(parts, "leader").select("block_id", "leader", F.pmod(F.xxhash64("block_id"), "parts").cast("int").alias("part"))
    sent = asking.join(dealt, ["leader", "part"]).groupBy("block_id").agg(F.collect_list(F.struct("leader", "shingles")).alias("leaders"))
    by_block = asked.groupBy("block_id").agg(F.collect_list(F.struct("n", "vertex", "leader", "groups")).alias("asked"))
    met = blocks.join(by_block, "block_id").join(sent, "block_id").select("payload", "asked", "leaders")
    return materialize(met.mapInArrow(_to_leaders(text), from_arrow_schema(LIKENESS)), "likeness")


def _rest(likeness: DataFrame) -> DataFrame:
    """Distinct (key, vertex): cells of the members that may have links which their leaders do not show."""
    far = F.col("likeness") < SIMILARITY
    nearest = likeness.where(far).groupBy("grp").agg(F.min("distance").alias("nearest"))
    left = likeness.join(nearest, "grp").where(F.col("distance") >= F.col("nearest") - WIDTH)
    cell = F.floor(F.col("distance") / WIDTH).cast("int")
    cells = left.withColumn("cell", F.explode(F.array(cell, cell - 1))).select(F.xxhash64("grp", "cell").alias("key"), "vertex", "likeness")
    several = cells.groupBy("key").agg(F.count("*").alias("size"), F.min("likeness").alias("least")).where((F.col("size") > 1) & (F.col("least") < SIMILARITY))
    return cells.join(several, "key", "left_semi").select("key", "vertex").distinct()


def _grouped(docs: DataFrame, text: str, key: str | None) -> tuple[DataFrame, DataFrame]:
    """Blocks of the documents, and (block_id, n, id, vertex, component) of their rows.

    Texts lie in bucketed blocks and are never shuffled: rows are known by block and number, and a block is told which of its
    rows' sets to send to which groups.
    """
    buckets = partitions_of(docs.sparkSession)
    blocks = write_blocks(docs, text).select("block_id", "payload")
    rows = materialize(blocks.mapInArrow(_vertices(text, key), ROWS_OF), "shingled")
    vertices = materialize(rows.groupBy("vertex").agg(F.min(F.struct("block_id", "n", "keys", "fp")).alias("at")), "vertices")
    groups = _groups(_candidates(vertices))
    vertices = vertices.select("vertex", "at.block_id", "at.n")
    likeness = _likeness(blocks, vertices, groups, text).withColumn("distance", 1 - F.col("likeness"))
    cells = _groups(_rest(likeness).withColumn("part", F.col("vertex")))
    asked = cells.groupBy("vertex").agg(F.collect_list("grp").alias("groups")).join(vertices, "vertex")
    met = _asked(blocks, asked, text, "grp bigint, vertex bigint, shingles binary")
    # Written once: labels need each edge both ways, and a second run may find another forest.
    others = materialize(met.repartition(buckets, "grp").sortWithinPartitions("grp", "vertex").mapInArrow(_linked, "a bigint, b bigint"), "links")
    edges = likeness.where(F.col("likeness") >= SIMILARITY).select(F.col("leader").alias("a"), F.col("vertex").alias("b")).distinct().unionByName(others)
    labels = component_labels(edges).withColumnRenamed("id", "vertex")
    return blocks, rows.drop("keys", "fp").join(labels, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``vertex`` and ``component``, equal for texts that a chain of resemblances of ``SIMILARITY`` or more joins.

    Texts without words, null ones too, have the empty set, and are copies of each other alone. Rows are documents of their own,
    whatever repeats; texts of any length are read whole; columns with these two names are replaced. An empty table gives no rows.
    """
    own = docs.drop("vertex", "component")
    schema = StructType([*own.schema.fields, StructField("vertex", LongType()), StructField("component", LongType())])
    arrow = to_arrow_schema(schema)
    names, (blocks, rows) = own.columns, _grouped(own, text, None)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, told = unpack(row["payload"]), sorted((r["n"], r["vertex"], r["component"]) for r in row["rows"])
                columns = [block.column(c).cast(arrow.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v for _, v, _ in told], pa.int64()), pa.array([c for _, _, c in told], pa.int64())], schema=arrow)

    told = rows.groupBy("block_id").agg(F.collect_list(F.struct("n", "vertex", "component")).alias("rows"))
    return blocks.join(told, "block_id").select("payload", "rows").mapInArrow(run, schema)


def first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest key of their component, one of each; rows without a key are all kept."""
    arrow = to_arrow_schema(docs.schema)
    blocks, rows = _grouped(docs, text, key)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack(row["payload"]).take(pa.array(sorted(row["kept"])))
                yield pa.RecordBatch.from_arrays([block.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    first = rows.where("id is not null").groupBy("component").agg(F.min(F.struct("id", "block_id", "n")).alias("first")).select("first.block_id", "first.n")
    kept = first.unionByName(rows.where("id is null").select("block_id", "n")).groupBy("block_id").agg(F.collect_list("n").alias("kept"))
    return blocks.join(kept, "block_id").select("payload", "kept").mapInArrow(run, docs.schema)

"""SimHash fingerprints, and their links by tables of distances to reference fingerprints.

References are the zero fingerprint, one for each of 16 blocks of four bits (ones in the block alone), and fixed
random ones. A fingerprint's distances to the zero and a block reference give the number of ones in the block; two
fingerprints at Hamming distance 2 or less have block counts that differ by 2 or less in sum. So each fingerprint is
posted under its counts and under all counts one step away: linked ones share a posting, and few others do. There a
table of distances to all references is computed once; groups that are too large are split by the reference that tells most,
pairs whose distances to any reference differ by more than the limit are discarded (the triangle inequality), and
what survives is compared bit by bit. A bucket emits a spanning forest of its links, not all pairs.

Equal fingerprints are one vertex throughout: copies are never paired.

Wide links, of up to ``WIDE_BITS`` bits, differ in two bits at most in one of three spans of 21 or 22 bits. Block counts would need too many
postings there, so a fingerprint is posted under each span's bits and under those with one bit turned; distances to references discard as above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.blocks import chunks, materialize, partitions_of, tidy
from tessera.operators.graph import component_labels

SEED, MAX_BITS, BLOCKS = 42, 2, 16
#: The fingerprint's column between steps; a name that no table has.
FP = "__simhash_fingerprint"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK_MASKS = np.array([0xF << (4 * b) for b in range(BLOCKS)], np.uint64)
REFERENCES = np.concatenate([np.zeros(1, np.uint64), BLOCK_MASKS, np.random.default_rng(5).integers(0, 1 << 64, 47, dtype=np.uint64)])
#: Fingerprints under one key that are compared pair by pair; larger groups are split by further references.
GROUP = 64
_STEPS = np.random.default_rng(6).integers(0, 1 << 64, BLOCKS, dtype=np.uint64)
#: The limit of wide links, and their spans: first bit and number of bits.
WIDE_BITS, SPANS = 8, ((0, 21), (21, 21), (42, 22))
#: For each posting of a fingerprint its span's bits, the bit it turns (0: none), and what tells spans apart.
_MASKS, _TURNS, _SALTS = (np.array(x, np.uint64) for x in zip(*(((1 << n) - 1 << a, turn, k) for k, (a, n) in enumerate(SPANS) for turn in (0, *(1 << a + i for i in range(n)))), strict=True))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Fingerprints under one key of wide links that are compared pair by pair; in larger groups links are followed from one to the next.
LARGE = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in more than half of the shingles' hashes, repeats counted; 0 without words."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, stops, strict=True)), np.uint64, n)
    return int(majority(h))


def majority(h: np.ndarray) -> np.uint64:
    """The bits set in over half of ``h``."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(np.ascontiguousarray(h[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = FP, keep_text: bool = False) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; a column of that name is replaced, the text goes unless kept."""
    own = StructType([f for f in docs.schema.fields if f.name != name and (keep_text or f.name != text)])
    schema = StructType([*own.fields, StructField(name, LongType())])
    arrow = to_arrow_schema(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            fps = np.array([fingerprint(t) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[part.column(n).cast(arrow.field(n).type) for n in own.names], pa.array(fps)], schema=arrow)

    return docs.mapInArrow(run, schema)


def distances(fps: np.ndarray, references: np.ndarray = REFERENCES) -> np.ndarray:
    """The table of Hamming distances to the references."""
    return np.bitwise_count(fps[:, None] ^ references[None, :])


def _posts(buckets: int):
    """Distinct fingerprints -> (bucket, keys, fps)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            table = distances(fps, REFERENCES[: BLOCKS + 1]).astype(np.int64)
            ones = (4 + table[:, :1] - table[:, 1:]) // 2
            with np.errstate(over="ignore"):
                home = (ones.astype(np.uint64) * _STEPS).sum(axis=1, dtype=np.uint64)
                keys, own = [home], [fps]
                for b in range(BLOCKS):
                    for step, possible in ((_STEPS[b], ones[:, b] < 4), (np.uint64(0) - _STEPS[b], ones[:, b] > 0)):
                        keys.append(home[possible] + step)
                        own.append(fps[possible])
            keys, own = np.concatenate(keys), np.concatenate(own)
            bucket = (keys >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            parts = [order[cuts[k] : cuts[k + 1]] for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([own[p].tobytes() for p in parts], pa.binary())], ["bucket", "keys", "fps"])

    return run


def _cells(table: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A large group's rows in lots such that any two whose distances to all references differ by ``most`` or less share a lot.

    Rows are split by the reference to which their distances vary most: to cells of ``most + 1`` distances, and a row that another
    one in the next cell can be near is in both. That goes on until a lot has at most GROUP rows or no reference tells it apart.
    """
    todo = [rows]
    while todo:
        own = todo.pop()
        if len(own) > GROUP:
            by = int(table[own].std(axis=0).argmax())
            d = table[own, by].astype(np.int64)
            cell, last = d // (most + 1), (d + most) // (most + 1)
            parts = [own[(cell == c) | (last == c)] for c in np.unique(cell)]
            if max(map(len, parts)) < len(own):
                todo += [p for p in parts if len(p) > 1]
                continue
        yield own


def linked_pairs(keys: np.ndarray, fps: np.ndarray, most: int = MAX_BITS, chunk: int = 1 << 18, group_size: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs among fingerprints that share a key; a pair may come more than once.

    The distance table is computed once, a row for each distinct fingerprint.
    """
    known, which = np.unique(fps, return_inverse=True)
    references = distances(known).astype(np.int8)
    order = np.lexsort((which, keys))
    keys, which = keys[order], which[order]
    if not len(keys):
        return
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (which[1:] != which[:-1])])
    keys, which = keys[fresh], which[fresh]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    group = np.repeat(np.arange(len(heads)), sizes)
    plain = np.flatnonzero((sizes <= group_size)[group])
    pieces, table = [(plain, group[plain])], references[which]
    for g in np.flatnonzero(sizes > group_size):
        pieces += [(lot, np.zeros(len(lot), np.int64)) for lot in _cells(table, np.arange(heads[g], heads[g] + sizes[g]), most)]
    for rows, lots in pieces:
        at, shift = np.arange(len(rows)), 1
        while True:
            at = at[at + shift < len(rows)]
            at = at[lots[at] == lots[at + shift]]
            if not len(at):
                break
            for k in range(0, len(at), chunk):
                a, b = which[rows[at[k : k + chunk]]], which[rows[at[k : k + chunk] + shift]]
                # The first references discard nearly all; the others see what is left.
                for some in (slice(0, 8), slice(8, 24), slice(24, None)):
                    near = (np.abs(references[a, some] - references[b, some]) <= most).all(axis=1)
                    a, b = a[near], b[near]
                real = np.bitwise_count(known[a] ^ known[b]) <= most
                if real.any():
                    yield known[a[real]], known[b[real]]
            shift += 1


@tidy
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's postings -> edges (a, b), a spanning forest of its links."""
    keys, fps = [], []
    for batch in batches:
        keys += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        fps += [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
    if keys:
        yield _spanning(linked_pairs(np.concatenate(keys), np.concatenate(fps)))


def _spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Edges (a, b), a spanning forest of the pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    ends = [(x, root(x)) for x in list(parent) if root(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([y for _, y in ends], pa.int64())], ["a", "b"])


def wide_keys(fps: np.ndarray, posts: np.ndarray) -> np.ndarray:
    """The keys of the postings of these numbers."""
    with np.errstate(over="ignore"):
        return ((fps ^ _TURNS[posts]) & _MASKS[posts]) * _FACTOR + _SALTS[posts]


def _wide_posts(buckets: int):
    """Distinct fingerprints -> (bucket, posts, fps): numbers of postings, from which keys follow."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            posts, own = np.repeat(np.arange(len(_MASKS), dtype=np.uint8), len(fps)), np.tile(fps, len(_MASKS))
            bucket = (wide_keys(own, posts) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            parts = [order[cuts[k] : cuts[k + 1]] for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([posts[p].tobytes() for p in parts], pa.binary()), pa.array([own[p].tobytes() for p in parts], pa.binary())], ["bucket", "posts", "fps"])

    return run


def _followed(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of a group's links: each fingerprint reached is compared only with those not reached yet."""
    table, left = distances(fps).astype(np.int8), np.arange(len(fps))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x, near = reached.pop(), left
            for some in (slice(0, 8), slice(8, 24), slice(24, None)):
                near = near[(np.abs(table[near, some] - table[x, some]) <= most).all(axis=1)]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= most]
            if len(near):
                yield np.full(len(near), fps[x]), fps[near]
                reached += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]


def wide_pairs(keys: np.ndarray, fps: np.ndarray, most: int = WIDE_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs among fingerprints that share a key: all of them, or a spanning forest where more than LARGE share it."""
    order = np.argsort(keys)
    keys, fps = keys[order], fps[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    several = np.repeat((sizes > 1) & (sizes <= LARGE), sizes)
    yield from linked_pairs(keys[several], fps[several], most, group_size=LARGE)
    for g in np.flatnonzero(sizes > LARGE):
        yield from _followed(np.unique(fps[heads[g] : heads[g] + sizes[g]]), most)


@tidy
def _wide_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's postings -> edges (a, b), a spanning forest of its wide links."""
    posts, fps = [], []
    for batch in batches:
        posts += [np.frombuffer(x, np.uint8) for x in batch.column(1).to_pylist()]
        fps += [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
    if posts:
        own = np.concatenate(fps)
        yield _spanning(wide_pairs(wide_keys(own, np.concatenate(posts)), own))


def wide_components(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, component) of those that have wide links: equal for fingerprints that a chain of them joins."""
    buckets = partitions_of(fps.sparkSession)
    posts = fps.select("fp").mapInArrow(_wide_posts(buckets), "bucket bigint, posts binary, fps binary")
    edges = posts.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_wide_forest, "a bigint, b bigint")
    # Written once: labels need each edge both ways, and a second run may find another forest.
    return component_labels(materialize(edges, "wide")).withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with fingerprint (16 hex digits) and component_id: the smallest key reachable over links.

    Null and empty texts have the zero fingerprint, which links like any other. Null keys are never the smallest, unless
    a component has no other. Repeated rows and keys stay as they are; texts of any length are read whole. Other columns pass
    through, those with a result's name are replaced, and the text goes unless ``keep_text``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(*[c for c in docs.columns if c not in ("fingerprint", "component_id")])
    marked = materialize(with_fingerprints(own, text, keep_text=keep_text), "fingerprints")
    vertices = marked.groupBy(F.col(FP).alias("fp")).agg(F.min(key).alias("least"))
    buckets = partitions_of(spark)
    posts = vertices.select("fp").mapInArrow(_posts(buckets), "bucket bigint, keys binary, fps binary")
    edges = posts.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_forest, "a bigint, b bigint")
    labels = component_labels(edges)
    placed = vertices.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = placed.join(least, "component").select(F.col("fp").alias(FP), "component_id")
    shown = F.lower(F.lpad(F.hex(FP), 16, "0")).alias("fingerprint")
    return marked.join(ids, FP).select(*[c for c in own.columns if keep_text or c != text], shown, "component_id")

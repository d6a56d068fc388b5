"""Exact removal of repeated byte strings across documents, by suffix arrays over hash-dealt pieces.

A document's bytes are removed where a string of ``width`` bytes covers them that also starts in a document with a
smaller id. Four steps, each spread over all executors:

1. Every window of ``width`` bytes is named by the smallest hash among its k-grams. Equal windows have equal names,
   so runs of windows with one name (*pieces*) can be dealt by name. Names alone are dealt first, four bytes for each
   that a block has; a name that only one document has cannot repeat and goes no further.
2. Pieces whose name recurs are dealt by name, equal pieces of a block once, with their smallest id in it. So a passage
   that a third of all documents have costs its bucket an entry a block, not one a document.
3. Where a name has several different pieces, windows that could be equal (by a rolling hash) are cut out and a
   generalised suffix array over the cuts, sorted by Lyndon groups, tells which windows are equal. Each window gets
   the smallest document id of its class. A single distinct piece needs no sorting: its windows are classes already.
4. Smallest ids go back to the blocks, which find their pieces again, compare, cut and hash.

Pieces are at most ``width - 1 + PIECE`` bytes, so a name that repeats along a whole text is still many small rows.

Null text is empty. A null id is neither an earlier source nor a later copy: such rows keep their bytes. Rows that
share an id remove nothing from each other. Other columns pass through; those with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.blocks import materialize, partitions_of, squeeze, text_buffer, tidy, unpack, unsqueeze, write_blocks
from tessera.llm.suffix_array import shared_windows
from tessera.llm.words import slices

GRAM, PIECE = 24, 256
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
NONE = np.iinfo(np.int64).max
RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _power(m: int) -> np.uint64:
    return np.uint64(pow(int(_M2), m, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each position on, by doubling."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        level, power, n = data.astype(np.uint64) * _M1, _M2, 1
        h, m = None, 0  # what the low bits of k have covered so far
        while True:
            if k & n:
                if h is None:
                    h, m = level, n
                else:
                    size = len(data) - (m + n) + 1
                    # the n bytes here, then the m bytes covered after them
                    h = level[:size] * _power(m) + h[n : n + size]
                    m += n
            if n * 2 > k:
                break
            level = level[:-n] * power + level[n:]
            power, n = power * power, n * 2
        h = h ^ (h >> np.uint64(29))
        h *= _M3
        h ^= h >> np.uint64(32)
    return h


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    out, n = h, 1
    while n * 2 <= w:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return out if n == w else np.minimum(out[: len(out) - (w - n)], out[w - n :])


def pieces(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, documents, starts, ends): runs of windows with one name within a document."""
    parts = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
    for lo, hi in slices(offsets):
        names, docs, starts, ends = _pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
        parts.append((names, docs + lo, starts + offsets[lo], ends + offsets[lo]))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    gram = min(gram, width)
    h = gram_hashes(data, gram)
    if len(data) < width:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, z
    names = _window_min(h, width - gram + 1)
    valid = np.ones(len(names), bool)
    for end in offsets[1:]:  # windows that would run over a document's end
        valid[max(0, end - width + 1) : end] = False
    fresh = np.empty(len(names), bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[1:] |= ~valid[:-1]
    fresh &= valid
    starts = np.flatnonzero(fresh)
    stops = np.minimum(np.append(starts[1:], len(names)), 1 << 62)
    docs = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(stops - 1 + width, offsets[docs + 1])
    long = ends - starts > width - 1 + PIECE
    if long.any():
        parts = [np.arange(s, e - width + 1, PIECE) for s, e in zip(starts[long], ends[long], strict=True)]
        cut = np.concatenate(parts)
        of = np.repeat(np.flatnonzero(long), [len(p) for p in parts])
        starts, docs, last = np.concatenate([starts[~long], cut]), np.concatenate([docs[~long], docs[of]]), np.concatenate([ends[~long], np.minimum(cut + PIECE - 1 + width, ends[of])])
        o = np.argsort(starts, kind="stable")
        starts, docs, ends = starts[o], docs[o], last[o]
    return names[starts], docs, starts, ends


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _distinct(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's pieces by bucket and name (the low 32 bits): (their order, where each distinct name begins in it, the names, where each bucket begins in these)."""
    keys = (_bucket(names, buckets).astype(np.uint64) << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    own = keys[heads]
    return order, heads, own.astype(np.uint32), np.searchsorted(own >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _named(buckets: int, width: int, text: str):
    """Blocks -> (bucket, block_id, names, several): a block's distinct names, and a bit for each that several of its documents have."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, offsets = text_buffer(unpack(payload).column(text))
                names, docs, _, _ = pieces(data, offsets, width)
                if not len(names):
                    continue
                order, heads, own, cuts = _distinct(names, buckets)
                docs = docs[order]
                several = docs[heads] != docs[np.append(heads[1:], len(docs)) - 1]  # in order of position, so of document, within a name
                full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([block_id] * len(full), pa.int64()), pa.array([own[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()), pa.array([np.packbits(several[cuts[k] : cuts[k + 1]]).tobytes() for k in full], pa.binary())],
                    ["bucket", "block_id", "names", "several"],
                )

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    """A partition's rows by bucket."""
    found: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            found.setdefault(row["bucket"], []).append(row)
    return found


@tidy
def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, block_id, flags): which of a block's names in the bucket two documents have, in this block or another."""
    for bucket, rows in _gather(batches).items():
        names = [np.frombuffer(r["names"], np.uint32) for r in rows]
        sizes = [len(x) for x in names]
        names = np.concatenate(names)
        flags = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n).view(bool) for r, n in zip(rows, sizes, strict=True)])
        order = np.argsort(names, kind="stable")
        n = names[order]
        heads = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        count = np.diff(np.append(heads, len(n)))
        flags[order] = np.repeat((count > 1) | np.logical_or.reduceat(flags[order], heads), count)
        parts = np.split(flags, np.cumsum(sizes)[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket] * len(rows), pa.int64()), pa.array([r["block_id"] for r in rows], pa.int64()), pa.array([squeeze(np.packbits(p)) for p in parts], pa.binary())], ["bucket", "block_id", "flags"]
        )


class _Occurrences:
    """A block's recurring pieces by bucket, the same whenever it is read."""

    def __init__(self, block: pa.RecordBatch, flags: list[dict], buckets: int, width: int, text: str, key: str) -> None:
        self.data, self.offsets = text_buffer(block.column(text))
        self.names, self.docs, self.starts, self.ends = pieces(self.data, self.offsets, width)
        self.ids = np.array([NONE if x is None else x for x in block.column(key).cast(pa.int64()).to_pylist()], np.int64)
        order, heads, _, cuts = _distinct(self.names, buckets)
        ends = np.append(heads[1:], len(order))
        #: Bucket -> its recurring pieces, in order of name and position.
        self.found: dict[int, np.ndarray] = {}
        for f in flags:
            lo, hi = cuts[f["bucket"]], cuts[f["bucket"] + 1]
            marked = np.unpackbits(unsqueeze(f["flags"], np.uint8), count=hi - lo).view(bool)
            if marked.any():
                self.found[f["bucket"]] = order[heads[lo] : ends[hi - 1]][np.repeat(marked, ends[lo:hi] - heads[lo:hi])]

    def strings(self, raw: bytes, bucket: int) -> tuple[list[bytes], np.ndarray]:
        """The bucket's distinct strings, and which of them each of its pieces is."""
        own, seen = self.found[bucket], {}
        which = [seen.setdefault(raw[s:e], len(seen)) for s, e in zip(self.starts[own].tolist(), self.ends[own].tolist(), strict=True)]
        return list(seen), np.array(which, np.int64)


def _candidates(buckets: int, width: int, text: str, key: str):
    """Blocks with flags -> (bucket, block_id, strings, sizes, names, least): a block's distinct recurring pieces, each with its smallest id there."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Occurrences(unpack(row["payload"]), row["flags"], buckets, width, text, key)
                out: dict[str, list] = {c: [] for c in CANDIDATES.names}
                raw = block.data.tobytes()
                for k, own in block.found.items():
                    strings, which = block.strings(raw, k)
                    least, names = np.full(len(strings), NONE, np.int64), np.empty(len(strings), np.uint32)
                    np.minimum.at(least, which, block.ids[block.docs[own]])
                    names[which] = block.names[own].astype(np.uint32)
                    for c, v in (("bucket", k), ("block_id", row["block_id"]), ("strings", squeeze(np.frombuffer(b"".join(strings), np.uint8))), ("sizes", squeeze(np.array([len(x) for x in strings], np.uint16))), ("names", names.tobytes()), ("least", squeeze(least))):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=CANDIDATES)

    return run


CANDIDATES = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), *[(c, pa.binary()) for c in ("strings", "sizes", "names", "least")]])


def _class_minima(strings: list[bytes], names: np.ndarray, least: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """For strings that share windows with a different string: the smallest id of each of its windows' classes."""
    order = np.argsort(names, kind="stable")
    n = names[order]
    heads = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    sizes = np.diff(np.append(heads, len(n)))
    several = np.flatnonzero(sizes > 1)
    if not len(several):
        return {}
    picked = np.concatenate([order[heads[k] : heads[k] + sizes[k]] for k in several])
    of = np.repeat(several, sizes[several])
    data = np.frombuffer(b"".join(strings[i] for i in picked), np.uint8)
    lengths = np.array([len(strings[i]) for i in picked], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    h = gram_hashes(data, width)
    # every window's start, with its string and name
    count = lengths - width + 1
    owner = np.repeat(np.arange(len(picked)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = h[offsets[owner] + within]
    with np.errstate(over="ignore"):
        h = h ^ (of[owner].astype(np.uint64) * _M1)
    o = np.argsort(h, kind="stable")
    s = np.flatnonzero(np.concatenate([[True], h[o][1:] != h[o][:-1]]))
    shared = np.zeros(len(h), bool)
    shared[o] = np.repeat(np.minimum.reduceat(owner[o], s) != np.maximum.reduceat(owner[o], s), np.diff(np.append(s, len(h))))
    out: dict[int, np.ndarray] = {}
    if not shared.any():
        return out
    # cut each string to the span of its windows that may be shared, and sort the cuts of a name together
    hit = np.flatnonzero(shared)
    first = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
    last = hit[np.concatenate([owner[hit][1:] != owner[hit][:-1], [True]])]
    groups: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        p, lo, hi = int(owner[a]), int(within[a]), int(within[z])
        i = int(picked[p])
        groups.setdefault(int(of[p]), {}).setdefault(strings[i][lo : hi + width], []).append((i, lo))
    for cuts in groups.values():
        contents = list(cuts)
        base = [min(least[i] for i, _ in users) for users in cuts.values()]
        minima = [np.full(len(c) - width + 1, m, np.int64) for c, m in zip(contents, base, strict=True)]
        if len(contents) > 1:
            for members in shared_windows(contents, width):
                low = min(base[k] for k, _ in members)
                for k, at in members:
                    if low < minima[k][at]:
                        minima[k][at] = low
        for k, users in enumerate(cuts.values()):
            for i, lo in users:
                own = np.full(len(strings[i]) - width + 1, least[i], np.int64)
                np.minimum(own[lo : lo + len(minima[k])], minima[k], out=own[lo : lo + len(minima[k])])
                out[i] = own
    return out


def _minima(width: int):
    """A bucket's candidates -> (block_id, bucket, least, odd, windows): of each of the block's strings the smallest id, and of those whose
    windows differ in that (their numbers are ``odd``) each window's."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _gather(batches).items():
            index: dict[tuple[int, bytes], int] = {}
            maps = []
            for r in rows:
                sizes, blob = unsqueeze(r["sizes"], np.uint16).astype(np.int64), unsqueeze(r.pop("strings"), np.uint8).tobytes()
                ends = np.cumsum(sizes).tolist()
                names = np.frombuffer(r.pop("names"), np.uint32).tolist()
                maps.append(np.array([index.setdefault((m, blob[s:e]), len(index)) for m, s, e in zip(names, [0, *ends[:-1]], ends, strict=True)], np.int64))
            least = np.full(len(index), NONE, np.int64)
            for m, r in zip(maps, rows, strict=True):
                np.minimum.at(least, m, unsqueeze(r.pop("least"), np.int64))
            mixed = _class_minima([b for _, b in index], np.array([m for m, _ in index], np.uint32), least, width)
            del index
            odd = np.zeros(len(least), bool)
            odd[list(mixed)] = True
            for m, r in zip(maps, rows, strict=True):
                own = np.flatnonzero(odd[m])
                windows = np.concatenate([mixed[k] for k in m[own].tolist()]) if len(own) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({"block_id": [r["block_id"]], "bucket": [bucket], "least": [squeeze(least[m])], "odd": [squeeze(own.astype(np.uint32))], "windows": [squeeze(windows)]}, schema=MINIMA)

    return run


MINIMA = pa.schema([("block_id", pa.int64()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in ("least", "odd", "windows")]])


def _spans(block: _Occurrences, minima: list[dict], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, stops) of byte ranges that a smaller id's document has."""
    raw = block.data.tobytes()
    for r in minima:
        own = block.found[r["bucket"]]
        strings, which = block.strings(raw, r["bucket"])
        ids, starts = block.ids[block.docs[own]], block.starts[own]
        odd = unsqueeze(r["odd"], np.uint32).astype(np.int64)
        mixed = np.zeros(len(strings), bool)
        mixed[odd] = True
        plain = ~mixed[which] & (unsqueeze(r["least"], np.int64)[which] < ids) & (ids != NONE)
        yield starts[plain], block.ends[own][plain]
        if not len(odd):
            continue
        # All windows of all odd pieces, end to end.
        count = np.zeros(len(strings), np.int64)
        count[odd] = [len(strings[k]) - width + 1 for k in odd.tolist()]
        first = np.cumsum(count) - count
        at = np.flatnonzero(mixed[which] & (ids != NONE))
        n = count[which[at]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = unsqueeze(r["windows"], np.int64)[np.repeat(first[which[at]], n) + within] < np.repeat(ids[at], n)
        begin = (np.repeat(starts[at], n) + within)[hit]
        yield begin, begin + width


def _cut(out_schema: pa.Schema, buckets: int, width: int, text: str, key: str, replace: bool):
    """Blocks with flags and minima -> the input's rows, with what was removed."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack(row["payload"])
                ranges = []
                if row["minima"]:
                    found = _Occurrences(block, row["flags"], buckets, width, text, key)
                    data, offsets = found.data, found.offsets
                    ranges = list(_spans(found, row["minima"], width))
                    del found
                else:
                    data, offsets = text_buffer(block.column(text))
                starts, stops = [np.concatenate(x) for x in zip(*ranges, strict=True)] if ranges else [np.empty(0, np.int64)] * 2
                edge = np.bincount(starts, minlength=len(data) + 1).astype(np.int32)
                edge -= np.bincount(stops, minlength=len(data) + 1).astype(np.int32)
                gone = np.cumsum(edge[:-1], out=edge[:-1]) > 0
                del edge, starts, stops, ranges
                rise = gone.copy()
                rise[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < offsets[1:]]
                rise[heads] = gone[heads]
                before = np.zeros(len(data) + 1, np.int32)
                np.cumsum(rise, out=before[1:])
                runs = before[offsets].astype(np.int64)
                np.cumsum(gone, out=before[1:])
                lost = before[offsets].astype(np.int64)
                n_gone, n_spans = np.diff(lost), np.diff(runs)
                keep, kept = data[~gone].tobytes(), offsets - lost
                del before, gone, rise
                rest = [keep[a:z] for a, z in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
                made = {
                    "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()),
                }
                if replace:
                    made[text] = pa.array([None if n is None else x.decode("utf-8", "ignore") for x, n in zip(rest, block.column(text).is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else block.column(f.name).cast(f.type) for f in out_schema], schema=out_schema)

    return run


def remove_repeats(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text", replace: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes that stay.

    ``replace`` also puts what stays in place of the text; a character that was cut through goes.
    """
    spark = docs.sparkSession
    result = StructType.fromDDL(RESULT)
    own = StructType([f for f in docs.schema.fields if f.name not in result.names])
    schema = StructType([*own.fields, *result.fields])
    blocks = write_blocks(docs.select(*own.names), text)
    buckets = partitions_of(spark)
    payloads = blocks.select("block_id", "payload")
    named = payloads.mapInArrow(_named(buckets, width, text), "bucket bigint, block_id bigint, names binary, several binary")
    flags = named.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_recurring, "bucket bigint, block_id bigint, flags binary")
    # Written, as are the minima: small, read twice, and what a lost executor falls back to.
    flags = materialize(flags, "flags").groupBy("block_id").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    flagged = payloads.join(flags, "block_id", "left")
    found = flagged.where("flags is not null").select("block_id", "payload", "flags").mapInArrow(_candidates(buckets, width, text, key), from_arrow_schema(CANDIDATES))
    minima = found.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_minima(width), from_arrow_schema(MINIMA))
    minima = materialize(minima, "minima").groupBy("block_id").agg(F.collect_list(F.struct("bucket", "least", "odd", "windows")).alias("minima"))
    return flagged.join(minima, "block_id", "left").select("payload", "flags", "minima").mapInArrow(_cut(to_arrow_schema(schema), buckets, width, text, key, replace), schema)

"""Language-model scoring: context-tree weighting over bytes, and a word-unigram base.

The tree's nodes are all contexts of the last 0 to ``DEPTH`` bytes that the training texts have. In each, a byte is
decomposed to eight binary choices with Krichevsky-Trofimov estimates; ``P_w = 1/2 P_kt + 1/2 * product of the deeper
contexts' P_w`` mixes all depths. After training the weights stand; a context that has not met a choice gives it 1/2. A
text's score is the sum over its bytes and one end symbol (byte 0, which also fills the context before the first byte).

The model grows with the corpus and is never whole in one place. Strings of DEPTH context bytes and a symbol are dealt by
the last ``ROOT`` bytes of context, so each bucket holds whole subtrees. Only sums at the ``ROOT - 1`` last bytes (65,536
contexts of 255 choices at most) meet on the driver, which returns the mixture down to that depth by broadcast. Each block
then asks the buckets for its own distinct strings; for each LOT blocks there is a copy of a bucket's subtrees, in another task, as
the endings that are common are so in every block. Word counts travel alike: each block posts its distinct words (as
64-bit hashes) with their training counts to buckets, and gets back the totals of its own words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.blocks import materialize, partitions_of, squeeze, text_buffer, tidy, unpack, unsqueeze, write_blocks
from tessera.llm.words import SPACED_BREAK, distinct, slices, tokens

DEPTH, ROOT, MERGE = 5, 3, 3_000_000
#: Blocks that ask one copy of a bucket's subtrees: with more blocks there are more copies, so no ending is asked by all of them in one task.
LOT = 512
TRAIN = "__in_training"
RESULT = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
_HALF = math.log(0.5)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each behind DEPTH zeros and before one, and where each text's coded symbols begin (n+1, less the zeros)."""
    n = len(offsets) - 1
    starts = offsets[:-1] + (DEPTH + 1) * np.arange(n) + DEPTH
    out = np.zeros(len(data) + (DEPTH + 1) * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], np.diff(offsets))] = data
    return out, starts


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each coded symbol the string of DEPTH context bytes and itself, oldest byte highest, and the symbols of each text."""
    text, starts = padded(data, offsets)
    code = np.zeros(max(0, len(text) - DEPTH), np.uint64)
    for k in range(DEPTH + 1):
        code = (code << np.uint64(8)) | text[k : k + len(code)]
    coded = np.ones(len(text), bool)
    for k in range(1, DEPTH + 1):
        coded[starts - k] = False
    return code[coded[DEPTH:]], np.diff(offsets) + 1


def _sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, codes, symbols of each text) over ranges of whole texts."""
    for a, z in slices(offsets):
        yield a, z, *_codes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])


def _block_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The distinct strings of a block, in order."""
    return distinct(np.concatenate([np.empty(0, np.uint64), *(distinct(code) for _, _, code, _ in _sliced(data, offsets))]))


def _ranks(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each code is among the sorted keys, by sorting codes with their places, 65,536 at a time."""
    out = np.empty(len(codes), np.int64)
    for a in range(0, len(codes), 1 << 16):
        part = codes[a : a + (1 << 16)]
        both = np.sort((part << np.uint64(16)) | np.arange(len(part), dtype=np.uint64))
        code = both >> np.uint64(16)
        heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        out[a + (both & np.uint64(0xFFFF)).astype(np.int64)] = np.repeat(np.searchsorted(keys, code[heads]), np.diff(np.append(heads, len(code))))
    return out


def _gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the last ROOT bytes of context."""
    h = ((keys >> np.uint64(8)) & np.uint64((1 << 8 * ROOT) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


_POSTS = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _row(bucket: int, block: int | None, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "block_id": [block], "keys": [squeeze(keys)], "counts": [squeeze(counts.astype(np.uint32))]}, schema=_POSTS)


def _posts(buckets: int, text: str):
    """Blocks -> words' training counts by block, and training grams (block_id null) by task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for block_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = unpack(payload)
                data, offsets = text_buffer(block.column(text))
                learned = block.column(TRAIN).to_numpy(zero_copy_only=False).astype(bool)
                h, doc = tokens(data, offsets, SPACED_BREAK)
                keys, inverse = np.unique(h, return_inverse=True)
                counts = np.bincount(inverse, weights=learned[doc], minlength=len(keys)).astype(np.uint32)
                bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                for k, own in _by_bucket(bucket, buckets):
                    yield _row(k, block_id, keys[own], counts[own])
                sizes = np.diff(offsets)
                kept = data[np.repeat(learned, sizes)]
                ends = np.concatenate([[0], np.cumsum(sizes[learned])])
                grams += [np.unique(code, return_counts=True) for _, _, code, _ in _sliced(kept, ends)]
                if sum(len(k) for k, _ in grams) > MERGE:
                    grams = [_merge(grams)]
        if grams:
            keys, counts = _merge(grams)
            for k, own in _by_bucket(_gram_bucket(keys, buckets), buckets):
                yield _row(k, None, keys[own], counts[own])

    return run


_FOUND = pa.schema([("kind", pa.string()), ("block_id", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
FOUND = "kind string, block_id bigint, bucket bigint, n bigint, v bigint, keys binary, counts binary"


@tidy
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's posts -> each block's word totals, the bucket's N and V, its training strings, and their sums above ROOT."""
    buckets: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            words, grams = buckets.setdefault(r["bucket"], ([], []))
            keys, counts = unsqueeze(r["keys"], np.uint64), unsqueeze(r["counts"], np.uint32).astype(np.int64)
            if r["block_id"] is not None:
                words.append((r["block_id"], keys, counts))
                continue
            grams.append((keys, counts))
            if len(grams) > 1 and sum(len(k) for k, _ in grams[1:]) > max(MERGE, len(grams[0][0])):  # never many times the distinct ones
                grams[:] = [_merge(grams)]
    for bucket, (words, grams) in buckets.items():
        if words:
            keys, totals = _merge([(k, c) for _, k, c in words])
            yield _found("sum", n=int(totals.sum()), v=int(np.count_nonzero(totals)))
            for block, k, _ in words:
                yield _found("words", block_id=block, bucket=bucket, counts=totals[np.searchsorted(keys, k)])
        if grams:
            keys, totals = _merge(grams)
            yield _found("grams", bucket=bucket, keys=keys, counts=totals)
            key, sums = _above(Subtrees.grow(keys, totals).levels[ROOT], ROOT)
            yield _found("above", bucket=bucket, keys=key, counts=sums.ravel())


def _found(kind: str, block_id=None, bucket=None, n=None, v=None, keys=None, counts=None) -> pa.RecordBatch:
    row = {"kind": kind, "block_id": block_id, "bucket": bucket, "n": n, "v": v, "keys": None if keys is None else squeeze(keys), "counts": None if counts is None else squeeze(counts)}
    return pa.RecordBatch.from_pydict({k: [x] for k, x in row.items()}, schema=_FOUND)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by the recurrence up to 7 and Stirling's series."""
    shift = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    z = x + 6
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of the counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - 2 * 0.5723649429247001


@dataclass
class Level:
    """The binary choices met at one depth: key (context, then the choice's node 1 to 255), counts, weights of Bayes' mixture.

    ``total`` is log P_w and ``stop`` the weight of the node's own estimate; going down, ``mixed`` and ``share`` are the
    mixture down to here and the weight left for deeper contexts, and ``one`` the probability of a one where no deeper context has met the choice.
    """

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    total: np.ndarray
    stop: np.ndarray
    mixed: np.ndarray | None = None
    share: np.ndarray | None = None
    one: np.ndarray | None = None

    @classmethod
    def of(cls, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deep: np.ndarray | None) -> Level:
        kt = _kt(zeros, ones)
        total = kt if deep is None else np.logaddexp(_HALF + kt, _HALF + deep)
        return cls(key, zeros, ones, total, np.ones(len(key)) if deep is None else np.exp(_HALF + kt - total))

    def descend(self, depth: int, above: Level | None) -> None:
        m, s = (0.0, 1.0) if above is None else (above.mixed[(at := np.searchsorted(above.key, _parents(self.key, depth)))], above.share[at])
        kt = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        self.mixed, self.share = m + s * self.stop * kt, s * (1 - self.stop)
        self.one = self.mixed + self.share * 0.5


def _parents(key: np.ndarray, depth: int) -> np.ndarray:
    """The same choices in the contexts one byte shorter."""
    return key & np.uint64((1 << 8 * depth) - 1)


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, [np.bincount(at, weights=v, minlength=len(keys)) for v in values]


def _above(level: Level, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What a level adds to the one above: keys, and rows of zeros, ones and log P_w."""
    key, sums = _sum_by(_parents(level.key, depth), level.zeros, level.ones, level.total)
    return key, np.stack(sums)


def _choices(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight binary choices of each (context, symbol): (context, node) and the bit taken."""
    symbol, context = keys & np.uint64(255), keys & ~np.uint64(255)
    for level in range(8):
        yield context | np.uint64(1 << level) | (symbol >> np.uint64(8 - level)), (symbol >> np.uint64(7 - level)) & np.uint64(1)


@dataclass
class Subtrees:
    """Levels of the weighted tree, by depth."""

    levels: dict[int, Level]

    @classmethod
    def grow(cls, keys: np.ndarray, counts: np.ndarray) -> Subtrees:
        """From training strings to the weights of depths DEPTH to ROOT."""
        both = list(_choices(keys))
        key, (ones, zeros) = _sum_by(np.concatenate([k for k, _ in both]), np.concatenate([counts * b for _, b in both]), np.concatenate([counts * (1.0 - b) for _, b in both]))
        levels = {DEPTH: Level.of(key, zeros, ones, None)}
        for depth in range(DEPTH - 1, ROOT - 1, -1):
            key, (zeros, ones, deep) = _above(levels[depth + 1], depth + 1)
            levels[depth] = Level.of(key, zeros, ones, deep)
        return cls(levels)

    @classmethod
    def top(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Subtrees:
        """From the buckets' sums to depths ROOT - 1 to 0, ready for use."""
        levels: dict[int, Level] = {}
        if parts:
            key, sums = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts], axis=1)
            for depth in range(ROOT - 1, -1, -1):
                key, (zeros, ones, deep) = _sum_by(key, *sums)
                levels[depth] = Level.of(key, zeros, ones, deep)
                key, sums = _above(levels[depth], depth) if depth else (key, sums)
            for depth in range(ROOT):
                levels[depth].descend(depth, levels.get(depth - 1))
        return cls(levels)

    def under(self, top: Subtrees) -> Subtrees:
        """All depths, the mixture brought down from ``top``."""
        levels = top.levels | self.levels
        for depth in sorted(self.levels):
            levels[depth].descend(depth, levels[depth - 1])
        return Subtrees(levels)

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last byte after the others."""
        out = np.zeros(len(keys))
        for key, bit in _choices(keys):
            p, left = np.full(len(key), 0.5), np.arange(len(key))
            for depth in sorted(self.levels, reverse=True):
                level, want = self.levels[depth], _parents(key[left], depth + 1)
                at = np.minimum(np.searchsorted(level.key, want), len(level.key) - 1)
                met = level.key[at] == want
                p[left[met]] = level.one[at[met]]
                left = left[~met]
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


ASKS = "bucket bigint, block_id bigint, keys binary, counts binary"


def _asks(buckets: int, text: str):
    """Blocks -> their distinct strings, by bucket."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = _block_grams(*text_buffer(unpack(payload).column(text)))
                for k, own in _by_bucket(_gram_bucket(keys, buckets), buckets):
                    yield pa.RecordBatch.from_pydict({"bucket": [k], "block_id": [block_id], "keys": [squeeze(keys[own])], "counts": [None]}, schema=_POSTS)

    return run


_ANSWERS = pa.schema([("kind", pa.string()), ("block_id", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary())])


def _answers(top):
    """A bucket's training strings (block_id null, first) and the blocks' strings after them -> their log10 probabilities."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, tree, known, value = None, None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                bucket = r["bucket"]
                if (bucket, r["salt"]) != lot:
                    lot, tree, known, value = (bucket, r["salt"]), Subtrees(top.value.levels), np.empty(0, np.uint64), np.empty(0)
                keys = unsqueeze(r["keys"], np.uint64)
                if r["block_id"] is None:
                    tree = Subtrees.grow(keys, unsqueeze(r["counts"], np.int64)).under(top.value)
                    known, value = keys, tree.logp(keys)
                    continue
                out, new = np.empty(len(keys)), np.ones(len(keys), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    out, new = value[at], known[at] != keys
                out[new] = tree.logp(keys[new])
                yield pa.RecordBatch.from_pydict({"kind": ["grams"], "block_id": [r["block_id"]], "bucket": [bucket], "counts": [squeeze(out)]}, schema=_ANSWERS)

    return run


def _lookup(keys: np.ndarray, bucket: np.ndarray, got: dict[int, bytes], dtype) -> np.ndarray:
    """The buckets' answers in the order of the keys."""
    out = np.zeros(len(keys), dtype)
    for k, at in _by_bucket(bucket, len(got) and max(got) + 1):
        out[at] = unsqueeze(got[k], dtype)
    return out


def score_texts(docs: DataFrame, training, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte.

    ``training``: a boolean column, true on the rows to learn from (null counts as false). Null and empty texts are one
    end token, and their score is that of ending at once; bits_per_byte is null for them. Columns with a result's name are replaced,
    others pass through. Repeated rows count and score each time, texts of any length whole. Without training rows every choice has
    probability 1/2 and the base is 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    result = StructType.fromDDL(RESULT)
    own = StructType([f for f in docs.schema.fields if f.name not in result.names and f.name not in (text, TRAIN)])
    schema = StructType([*own.fields, *result.fields])
    arrow = to_arrow_schema(schema)
    blocks = write_blocks(docs.select(*own.names, text, F.coalesce(training, F.lit(False)).alias(TRAIN)), text)
    buckets = partitions_of(spark)
    ends = docs.agg(F.count_if(training)).first()[0]
    payloads = blocks.select("block_id", "payload")
    posts = payloads.mapInArrow(_posts(buckets, text), ASKS)
    found = materialize(posts.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_totals, FOUND), "counts")
    n, v = found.where("kind = 'sum'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    above = []
    for r in found.where("kind = 'above'").select("keys", "counts").toLocalIterator():
        above.append((unsqueeze(bytes(r["keys"]), np.uint64), unsqueeze(bytes(r["counts"]), np.float64).reshape(3, -1)))
        if sum(len(k) for k, _ in above) > MERGE:
            key, sums = _sum_by(np.concatenate([k for k, _ in above]), *np.concatenate([c for _, c in above], axis=1))
            above = [(key, np.stack(sums))]
    top = spark.sparkContext.broadcast(Subtrees.top(above))
    salts = blocks.count() // LOT + 1
    asks = payloads.mapInArrow(_asks(buckets, text), ASKS).withColumn("salt", F.pmod(F.xxhash64("block_id"), F.lit(salts)).cast("int"))
    trees = found.where("kind = 'grams'").select("bucket", "block_id", "keys", "counts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    home = F.pmod(F.col("bucket") + F.col("salt") * 7919, F.lit(buckets)).cast("int")
    dealt = asks.unionByName(trees).repartitionById(buckets, home).sortWithinPartitions("bucket", "salt", F.col("block_id").asc_nulls_first())
    answers = dealt.mapInArrow(_answers(top), "kind string, block_id bigint, bucket bigint, counts binary")
    base = math.log10(n + v + 1)
    replies = answers.unionByName(found.where("kind = 'words'").select("kind", "block_id", "bucket", "counts"))
    replies = replies.groupBy("block_id").agg(F.collect_list(F.struct("kind", "bucket", "counts")).alias("replies"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack(row["payload"])
                data, offsets = text_buffer(block.column(text))
                h, doc = tokens(data, offsets, SPACED_BREAK)
                keys, inverse = np.unique(h, return_inverse=True)
                got = {kind: {r["bucket"]: r["counts"] for r in row["replies"] or [] if r["kind"] == kind} for kind in ("words", "grams")}
                c = _lookup(keys, ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), got["words"], np.int64)[inverse]
                grams = _block_grams(data, offsets)
                logp = _lookup(grams, _gram_bucket(grams, buckets), got["grams"], np.float64)
                score = np.zeros(block.num_rows)
                for a, z, codes, sizes in _sliced(data, offsets):
                    score[a:z] = np.add.reduceat(logp[_ranks(codes, grams)], np.cumsum(sizes) - sizes)
                rows = block.num_rows
                n_tokens = np.bincount(doc, minlength=rows) + 1
                known = np.bincount(doc, weights=c > 0, minlength=rows).astype(np.int64) + (ends > 0)
                plain = np.bincount(doc, weights=np.log10(c + 1.0), minlength=rows) + math.log10(ends + 1) - n_tokens * base
                size = np.diff(offsets)
                bits = np.divide(-score * math.log2(10), size, out=np.zeros(rows), where=size > 0)
                made = {
                    "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array([n] * rows, pa.int64()), "base_score": pa.array(plain),
                    "score": pa.array(score), "bits_per_byte": pa.array(bits, mask=size == 0),
                }
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else block.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return payloads.join(replies, "block_id", "left").select("payload", "replies").mapInArrow(run, schema)

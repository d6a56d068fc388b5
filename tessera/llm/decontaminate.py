"""Benchmark decontamination with a positional inverted index.

The corpus is indexed in segments, one row each, in a table in the shared checkpoint folder that is bucketed by segment, so that it is never shuffled: for every term its ascending word
positions. A phrase is found by intersecting the lists of its terms, shifted by their offsets in the phrase, from the
shortest list to the longest; a proximity query asks for all terms within some words instead. Documents are laid
out with gaps between them, so a match never spans two.

Benchmark phrases are dealt, not copied: each goes, by the term that is rarest in the corpus, to the segments that have
that term, and is intersected there with the segment's lists. Neither the benchmark nor the index is ever whole in one place, and
phrases reach a segment in lots of about ``LOT``.

Terms are 64-bit hashes of lower-cased words. Null texts and texts without words are in the index with no positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.blocks import chunks, pack, partitions_of, squeeze, task_ids, text_buffer, tidy, unpack, unsqueeze
from tessera.llm.words import ALNUM_BREAK, tokens
from tessera.operators.checkpoints import cut, cut_by

WINDOW, GAP, LOT = 10, 64, 1 << 17
RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def word_hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Each text's words as hashes."""
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    found, doc = tokens(data, offsets, ALNUM_BREAK)
    return np.split(found, np.searchsorted(doc, np.arange(1, len(texts))))


def phrases(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, item): every ``window`` words in a row of each item, or all words of a shorter one, as the terms' bytes; repeats go."""

    @tidy
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            names, found, owner = part.column("item").to_pylist(), [], []
            for name, words in zip(names, word_hashes(part.column("text").to_pylist()), strict=True):
                raw, n = words.tobytes(), len(words)
                own = {raw[8 * i : 8 * (i + window)] for i in range(max(1, n - window + 1) if n else 0)}
                found += own
                owner += [name] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(owner, pa.string())], ["phrase", "item"])

    return items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut_up, "phrase binary, item string").distinct()


def build_index(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Segments (segment, rows, n_words, terms, sizes, positions); ``rows`` holds the documents' other columns, and the text if kept."""
    others, buckets = [c for c in docs.columns if keep_text or c != text], partitions_of(docs.sparkSession)

    @tidy
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = task_ids(TaskContext.get().partitionId(), buckets)
        for part in chunks(batches, text):
            data, offsets = text_buffer(part.column(text))
            h, doc = tokens(data, offsets, ALNUM_BREAK)
            order = np.argsort(h, kind="stable")
            at = (np.arange(len(h)) + GAP * doc)[order]
            h = h[order]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            columns = (np.bincount(doc, minlength=part.num_rows).astype(np.int64), h[heads], np.diff(np.append(heads, len(h))).astype(np.uint32), at.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([next(ids)]), pa.array([pack(part.select(others))], pa.binary()), *(pa.array([squeeze(c)], pa.binary()) for c in columns)], ["segment", "rows", "n_words", "terms", "sizes", "positions"])

    return cut_by(docs.mapInArrow(index, "segment bigint, rows binary, n_words binary, terms binary, sizes binary, positions binary"), "segment", buckets)


def term_sizes(index: DataFrame) -> DataFrame:
    """(term, segment, n): how long each segment's lists are."""

    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = unsqueeze(row["terms"], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), row["segment"])), pa.array(unsqueeze(row["sizes"], np.uint32).astype(np.int64))], ["term", "segment", "n"])

    return index.select("segment", "terms", "sizes").mapInArrow(spread, "term bigint, segment bigint, n bigint")


def _member(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)
    return sorted_set[at] == h


class Postings:
    """One segment's lists."""

    def __init__(self, terms: bytes, sizes: bytes, positions: bytes) -> None:
        self.terms = unsqueeze(terms, np.uint64)
        self.ends = np.cumsum(unsqueeze(sizes, np.uint32).astype(np.int64))
        self.positions = unsqueeze(positions, np.uint32).astype(np.int64)

    def sizes_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each term, length of its list), 0 for unknown terms."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        row = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        size = np.diff(np.concatenate([[0], self.ends]))[row]
        return row, np.where(self.terms[row] == terms, size, 0)

    def of(self, row: int) -> np.ndarray:
        return self.positions[self.ends[row - 1] if row else 0 : self.ends[row]]

    def phrase(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Start positions of the phrase, from its rarest term on."""
        order = np.argsort(sizes, kind="stable")
        starts = self.of(rows[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            starts = starts[_member(starts + k, self.of(rows[k]))]
        return starts

    def near(self, rows: Sequence[int], within: int, first: np.ndarray | None = None) -> np.ndarray:
        """(n, 2) first and last positions of the spans of at most ``within`` words that hold every term, the smallest around each place of the rarest.

        ``first``: the documents' first positions; they are moved apart if ``within`` exceeds their gap.
        """
        lists, wider = [self.of(r) for r in rows], max(0, within - GAP)
        if wider and first is not None:
            lists = [x + wider * (np.searchsorted(first, x, side="right") - 1) for x in lists]
        return smallest_spans(lists, within)


def smallest_spans(lists: Sequence[np.ndarray], within: int) -> np.ndarray:
    """For each place of the shortest list, the smallest span around it that holds a place of every list, if it has at most ``within`` words."""
    place = min(lists, key=len)
    starts = np.unique(np.concatenate(lists))
    ends, none = starts.copy(), np.iinfo(np.int64).max
    for x in lists:
        i = np.searchsorted(x, starts)
        ends = np.maximum(ends, np.where(i < len(x), x[np.minimum(i, len(x) - 1)], none))
    lo, size = place.copy(), np.full(len(place), none)
    at, live = np.searchsorted(starts, place), np.arange(len(place))
    while len(live):
        left = starts[at[live]]
        own = np.maximum(ends[at[live]], place[live]) - left
        better = own < size[live]
        lo[live[better]], size[live[better]] = left[better], own[better]
        at[live] -= 1
        live = live[at[live] >= 0]
        live = live[place[live] - starts[at[live]] < np.minimum(within, size[live])]
    return np.stack([lo, lo + size], 1)[size < within]


def phrase_hits(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(segment, phrase, starts): where each of the distinct (phrase) begins, in positions of the segments that hold it."""
    wanted = wanted.where(F.octet_length("phrase") > 0)

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("phrase").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("phrase"), pa.array([np.unique(np.frombuffer(p, np.int64)) for p in own], pa.list_(pa.int64()))], ["phrase", "terms"])

    spelt = cut(wanted.select("phrase").mapInArrow(split, "phrase binary, terms array<bigint>").select("phrase", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")))
    known = cut(term_sizes(index).join(spelt.select("term").distinct(), "term", "left_semi"))
    totals = known.groupBy("term").agg(F.sum("n").alias("total"))
    met = spelt.join(totals, "term").groupBy("phrase").agg(F.first("n_terms").alias("n_terms"), F.count("*").alias("met"), F.min(F.struct("total", "term")).alias("rarest"))
    lots = max(1, wanted.count() // LOT)
    asked = met.where("met = n_terms").select("phrase", F.col("rarest.term").alias("term")).join(known.select("term", "segment"), "term")
    asked = asked.groupBy("segment", F.pmod(F.xxhash64("phrase"), F.lit(lots)).alias("lot")).agg(F.collect_list("phrase").alias("phrases"))

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists, found, places = Postings(row["terms"], row["sizes"], row["positions"]), [], []
                for n in {len(p) for p in row["phrases"]}:
                    own = [p for p in row["phrases"] if len(p) == n]
                    rows, sizes = lists.sizes_of(np.frombuffer(b"".join(own), np.uint64).reshape(len(own), -1))
                    for k in np.flatnonzero((sizes > 0).all(axis=1)).tolist():
                        starts = lists.phrase(rows[k], sizes[k])
                        if len(starts):
                            found.append(own[k])
                            places.append(squeeze(starts.astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * len(found), pa.int64()), pa.array(found, pa.binary()), pa.array(places, pa.binary())], ["segment", "phrase", "starts"])

    searched = index.select("segment", "terms", "sizes", "positions").join(asked, "segment").select("segment", "terms", "sizes", "positions", "phrases")
    return searched.mapInArrow(search, "segment bigint, phrase binary, starts binary")


def proximity_matches(index: DataFrame, words: Sequence[str], within: int, key: str = "doc_id") -> DataFrame:
    """(key, first, last): spans of at most ``within`` words that hold all ``words``, the smallest around each place of the rarest."""
    terms = np.array([h[0] for h in word_hashes(list(words))], np.uint64)

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists = Postings(row["terms"], row["sizes"], row["positions"])
                n = unsqueeze(row["n_words"], np.int64)
                first = np.cumsum(n) - n + GAP * np.arange(len(n))
                rows, sizes = lists.sizes_of(terms)
                if len(terms) and (sizes > 0).all():
                    spans = lists.near(rows, within, first)
                    first = first + max(0, within - GAP) * np.arange(len(n))
                    d = np.searchsorted(first, spans[:, 0], side="right") - 1
                    ids = unpack(row["rows"]).column(key).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(spans[:, 0] - first[d]), pa.array(spans[:, 1] - first[d])], [key, "first", "last"])

    return index.mapInArrow(search, f"`{key}` bigint, first bigint, last bigint")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text unless kept) with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0).

    Items of fewer than ``window`` words are one phrase; null and empty texts, of documents or items, have no words. Repeated item
    ids and texts count once, null ids mark words but are not listed. Rows that share a key are documents of their own; columns
    with a result's name are replaced. A text of any length is whole in one segment. An empty benchmark hits nothing.
    """
    owned = cut(phrases(benchmark, window, item, item_text))
    result = StructType.fromDDL(RESULT)
    own = StructType([f for f in docs.schema.fields if f.name not in result.names and (keep_text or f.name != text)])
    schema = StructType([*own.fields, *result.fields])
    arrow = to_arrow_schema(schema)
    index = build_index(docs.select(*dict.fromkeys([*own.names, text])), text, keep_text)
    hits = phrase_hits(index, owned.select("phrase").distinct()).join(owned, "phrase")
    by_segment = hits.groupBy("segment").agg(F.collect_list(F.struct(F.octet_length("phrase").alias("size"), "starts", "item")).alias("hits"))
    joined = index.select("segment", "rows", "n_words").join(by_segment, "segment", "left").select("rows", "n_words", "hits")

    @tidy
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, rest = unsqueeze(row["n_words"], np.int64), unpack(row["rows"])
                first = np.cumsum(words) - words + GAP * np.arange(len(words))
                covered, items = [np.empty(0, np.int64)], {}
                for h in row["hits"] or []:
                    starts = unsqueeze(h["starts"], np.uint32).astype(np.int64)
                    covered.append((starts[:, None] + np.arange(h["size"] // 8)).ravel())
                    if h["item"] is not None:
                        for d in np.unique(np.searchsorted(first, starts, side="right") - 1).tolist():
                            items.setdefault(d, set()).add(h["item"])
                at = np.unique(np.concatenate(covered))
                n_hit = np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(words)).astype(np.int64)
                named = [sorted(items.get(k, ())) for k in range(len(words))]
                made = {
                    "n_words": pa.array(words), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in named], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()), "contaminated": pa.array(n_hit > 0),
                }
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else rest.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return joined.mapInArrow(report, schema)

"""Inverted index and boolean retrieval."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.postings import decode_gaps
from tessera.functions.text import abbreviate, tokenize
from tessera.operators.checkpoints import checkpoint_dir
from tessera.operators.packed import pack, summed, unpack

#: Document ids of a segment: a list holds at most so many postings, however common its term.
SPAN = 4096
#: Tokens that a task counts at once, and postings that it hands on at once.
TOKENS, POSTINGS = 3_000_000, 1_000_000


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, doc, tf) from a table with ``doc`` and ``text``."""
    terms = docs.select("doc", F.explode_outer(tokenize(F.col("text"))).alias("term")).where("term is not null")
    return terms.groupBy("term", "doc").agg(F.count("*").alias("tf"))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(docs, their tokens) of about TOKENS at a time; a text is never cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
            yield batch.column(0).slice(at, after - at).to_numpy(), batch.column(1).slice(at, after - at)
            at = after


def build_index(docs: DataFrame, span: int = SPAN, partitions: int | None = None) -> DataFrame:
    """(term, segment, df, postings): postings are (gap, tf), ascending by doc; a term has a list for each ``span`` ids that hold it.

    ``df`` counts the list's documents, see :func:`document_frequencies` for the term's. Terms without documents have no row.
    A task counts the terms of many texts at once and shuffles postings as packed blocks, dealt by term and segment. Lists are sorted
    by term within the partitions, but for documents without an id.
    """
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens in _lots(batches):
            coded = tokens.flatten().dictionary_encode()
            terms = coded.dictionary.to_pylist()
            if not terms:
                continue
            ids, of = np.unique(ids, return_inverse=True)
            held = np.repeat(of, pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            held += coded.indices.to_numpy().astype(np.int64) * len(ids)
            held, tf = summed(held, None)
            term, of = np.divmod(held, len(ids))
            hashes = np.fromiter((zlib.crc32(t.encode()) for t in terms), np.int64, len(terms))
            part = (hashes[term] + ids[of] // span) % parts
            order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
            part, term, doc, tf = part[order], term[order], ids[of[order]], tf[order]
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            blocks, words = [], []
            for a, b in pairwise(edges.tolist()):
                new = np.diff(term[a:b], prepend=-1) > 0
                words.append("\n".join([terms[t] for t in term[a:b][new].tolist()]).encode())
                blocks.append(pack(np.cumsum(new) - 1, doc[a:b], tf[a:b]))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[edges[:-1]], pa.int32()), "terms": pa.array(words, pa.binary()), "block": pa.array(blocks, pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, blocks, size = [], [], 0
        for batch in batches:
            for found, block in zip(batch.column("terms").to_pylist(), batch.column("block"), strict=True):
                words.append(pa.array(found.decode().split("\n")))
                number, *rest = unpack(block.as_buffer())
                blocks.append((number + size, *rest))
                size += len(words[-1])
        if not blocks:
            return
        number, doc, tf = map(np.concatenate, zip(*blocks, strict=True))
        blocks.clear()
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        terms, number = coded.dictionary.take(order), rank[coded.indices.to_numpy()][number]
        order = np.lexsort((doc, number))
        number, doc, tf = number[order], doc[order], tf[order]
        first = np.flatnonzero((np.diff(number, prepend=-1) != 0) | np.append(True, doc[1:] != doc[:-1]))
        number, doc, tf = number[first], doc[first], np.add.reduceat(tf, first)
        segment = doc // span
        heads = (np.diff(number, prepend=-1) != 0) | np.append(True, segment[1:] != segment[:-1])
        gap, starts = np.where(heads, doc, doc - np.append(0, doc[:-1])), np.flatnonzero(heads)
        ends = np.append(starts[1:], len(doc))
        at = 0
        while at < len(starts):
            to = min(max(at + 1, int(np.searchsorted(ends, starts[at] + POSTINGS, "right"))), at + 20000)
            a, b, lists = starts[at], ends[to - 1], starts[at:to]
            entries = pa.StructArray.from_arrays([pa.array(gap[a:b]), pa.array(tf[a:b])], names=["gap", "tf"])
            postings = pa.ListArray.from_arrays(pa.array(np.append(lists, b) - a, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(number[lists])), pa.array(segment[lists]), pa.array(ends[at:to] - lists), postings], names=["term", "segment", "df", "postings"])
            at = to

    doc = F.col("doc").cast("bigint").alias("doc")
    tokens = docs.where("doc is not null and text is not null").select(doc, tokenize(F.col("text")).alias("tokens"))
    packed = tokens.mapInArrow(count, "part int, terms binary, block binary").repartitionById(parts, F.col("part"))
    dealt = packed.mapInArrow(merge, "term string, segment bigint, df bigint, postings array<struct<gap:bigint,tf:bigint>>")
    lost = term_frequencies(docs.where("doc is null").select(doc, "text")).groupBy("term").agg(F.lit(None).cast("bigint").alias("segment"), F.count("*").alias("df"), F.collect_list(F.struct(F.col("doc").alias("gap"), "tf")).alias("postings"))
    return dealt.union(lost)


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all segments."""
    return index.groupBy("term").agg(F.sum("df").alias("df"))


def stored_index(docs: DataFrame, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """The index written once, dealt and sorted by term, so that a filter on terms reads few row groups; in the shared folder unless ``path``."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    build_index(docs, partitions=partitions).write.mode("overwrite").parquet(path)
    return open_index(spark, path)


def open_index(spark, path: str) -> DataFrame:
    """A stored index."""
    return spark.read.schema("term string, segment bigint, df bigint, postings array<struct<gap:bigint,tf:bigint>>").parquet(path)


def postings_of(index: DataFrame, terms: list[str]) -> DataFrame:
    """(term, doc, tf) of some terms; none for unknown ones. The filter reaches the index's scan."""
    return decode_gaps(index.where(F.col("term").isin(terms)), ["term", "segment"]).select("term", "doc", "tf")


def _operands(rpn: str) -> list[str]:
    return [t for t in rpn.split() if t not in ("AND", "OR")]


def _matches(rpn: str, terms: Column) -> Column:
    """Whether a document that holds ``terms`` of the query matches. The top of the stack is the answer."""
    stack: list[Column] = []
    for token in rpn.split():
        if token in ("AND", "OR"):
            if len(stack) < 2:
                raise ValueError(f"{token} lacks an operand in {rpn!r}")
            right, left = stack.pop(), stack.pop()
            stack.append(left & right if token == "AND" else left | right)
        else:
            stack.append(F.array_contains(terms, token))
    if not stack:
        raise ValueError("empty query")
    return stack[-1]


def boolean_queries(index: DataFrame, rpns: list[str]) -> DataFrame:
    """(query, doc) for queries in reverse Polish notation: terms, AND, OR.

    One scan reads the postings of all terms, and one exchange by document brings together which of them it holds; the queries
    are expressions over that.
    """
    none = F.lit(None).cast("string")
    hits = [F.when(_matches(q, F.col("terms")), F.lit(q)).otherwise(none) for q in rpns]
    wanted = sorted(set(reduce(list.__add__, map(_operands, rpns), [])))
    held = postings_of(index, wanted).groupBy("doc").agg(F.collect_set("term").alias("terms"))
    return held.select(F.explode(F.array_compact(F.array(*hits))).alias("query"), "doc")


def boolean_query(index: DataFrame, rpn: str) -> DataFrame:
    """(doc) that match one query."""
    return boolean_queries(index, [rpn]).select("doc")


def fetch_lines(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their text, cut at 80 characters."""
    return hits.join(docs.select("doc", abbreviate(F.col("text")).alias("snippet")), "doc")

"""Packing of documents into token sequences, in order, by dynamic programming.

The tokens of a run of documents are laid end to end. Cuts may fall at a document's end (free), a sentence's end or,
dearer, elsewhere; a sequence costs its padding. ``cost[b] = min over a of cost[a] + padding(b - a) + cut(b)`` over the
cuts ``a`` of the last 2048 tokens: as padding is linear in ``a``, the best is the front of a monotone queue. Sequences
whose size is a power of two need no padding and are tried besides.

Runs are chunks of a few megabytes of text; their last sequences may be split to powers of two as well, so a run
loses little. Every id of every document, the end token included, lies in one piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.blocks import chunks, kept, tidy

SIZE, END_ID = 2048, 1
#: Bytes of text whose tokens are laid end to end; one longer text is a run of its own, whole.
RUN = 4 << 20
#: In tokens of padding: a sequence more, a cut at a sentence's end, a cut inside a sentence.
SEQUENCE_COST, SENTENCE_COST, HARD_COST = 64, 8, 64
#: Words whose ids a process remembers; beyond that, those it met once are forgotten, then all but the most met half.
CACHE = 400_000
#: Characters whose words are listed at once.
LISTED = 1 << 19

# What the vocabulary's own splitter takes as letters and digits, among the characters that the short cut admits.
_LETTERS, _DIGITS = "a-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_PLAIN = re.compile("[\t\n\r -~¡-įı-ſ]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^ \t\n\r{_LETTERS}{_DIGITS}]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Words with their numbers; a word that is looked up for the first time gets the next one and is listed as new."""

    def __init__(self, *known) -> None:
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Ids of whole texts. A word's ids don't depend on its neighbours, so each new word is encoded once a process.

    Texts beyond Latin letters, or with a special token's marks, go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core, not all of them
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        n = max(vocab.values()) + 1
        self.last, self.stop = np.zeros(n, bool), np.zeros(n, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
            self.stop[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        self.reset()

    def reset(self) -> None:
        self.index = _Numbers()
        self.pool, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.met = np.empty(0, np.int64)

    def forget(self) -> None:
        """Keep the words met most, and their counts."""
        least = max(2, int(np.partition(self.met, -(CACHE // 2))[-(CACHE // 2)]) + 1)
        keep = np.flatnonzero(self.met >= least)
        words = list(self.index)
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.pool = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[keep] - (ends - sizes), sizes)]
        self.starts, self.sizes, self.met = ends - sizes, sizes, self.met[keep]
        self.index = _Numbers((words[k], n) for n, k in enumerate(keep.tolist()))

    def learn(self, words: list[str]) -> None:
        """The ids of new words, in the order of their numbers."""
        lots = [" ".join(words[k : k + 2000]) for k in range(0, len(words), 2000)]
        found = (np.array(e.ids, np.uint32) for k in range(0, len(lots), 8) for e in self.tokenizer.encode_batch_fast(lots[k : k + 8], add_special_tokens=False))
        ids = np.concatenate(list(found))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a word is not what was taken for one
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
        sizes = np.diff(ends, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.pool) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, ids])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids, then the end token; the words of so many characters are listed at once, or of one longer text."""
        out, start, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= LISTED or k + 1 == len(texts):
                out += self._encode(texts[start : k + 1])
                start, size = k + 1, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > CACHE:
            self.forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, words, counts = [], [], []
        for k, t in enumerate(texts):
            t = t or ""
            if "<|" not in t and _PLAIN.fullmatch(t):
                own = _WORD.findall(t.lower())
                plain.append(k)
                words += own
                counts.append(len(own))
            else:
                out[k] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END_ID], np.uint32)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self.learn(self.index.new)
            self.index.new = []
        self.met += np.bincount(which, minlength=len(self.met))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - (ends - sizes), sizes)
        ids = self.pool[flat]
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)] if plain else []
        for n, k in enumerate(plain):
            out[k] = np.append(ids[at[n] : at[n + 1]], np.uint32(END_ID))
        return out


def shared_encoder(path: str) -> Encoder:
    """The process's encoder: a worker that goes on to other tasks of this operator keeps the words it has learned."""
    return kept(__name__, path, Encoder)


def padding(n: int, size: int = SIZE) -> int:
    """What a sequence of ``n`` tokens is padded by: up to ``size``, or not at all if ``n`` is a power of two."""
    return 0 if n & (n - 1) == 0 else size - n


def cuts(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of the sequences, ascending, the last at ``total``."""
    if not total:
        return []
    docs = np.asarray(doc_ends, np.int64)
    known = np.unique(np.concatenate([[0, total], docs, sentence_ends]))
    step = size // 2
    gaps = np.flatnonzero(np.diff(known) > step)
    hard = [np.arange(known[g] + step, known[g + 1], step) for g in gaps]
    hard.append(np.arange(max(1, total - size), total))
    at = np.unique(np.concatenate([known, *hard]))
    costs = np.full(len(at), HARD_COST)
    costs[np.searchsorted(at, sentence_ends)] = SENTENCE_COST
    costs[np.searchsorted(at, docs)] = 0
    costs[-1] = 0
    penalty = (costs + SEQUENCE_COST).tolist()
    exact: dict[int, list[int]] = {}
    p = 64  # smaller ones cost more as sequences than they save
    while p < size:
        prior = np.searchsorted(at, at - p)
        for b in np.flatnonzero(at[np.minimum(prior, len(at) - 1)] == at - p).tolist():
            exact.setdefault(b, []).append(int(prior[b]))
        p *= 2
    where = at.tolist()
    best, back = [0] * len(where), [0] * len(where)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost[a] + a, index of a, a), ascending in all three
    for b in range(1, len(where)):
        here = where[b]
        while queue[0][2] < here - size:
            queue.popleft()
        low, a, _ = queue[0]
        low += size - here
        if b in exact:
            for e in exact[b]:
                if best[e] < low:
                    low, a = best[e], e
        low += penalty[b]
        best[b], back[b] = low, a
        low += here
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, b, here))
    out, b = [], len(where) - 1
    while b:
        out.append(where[b])
        b = back[b]
    return out[::-1]


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids.

    A null or empty text is its end token alone. Rows that share a key, or are equal, are documents of their own; null keys stay. A
    text of any length is cut like others, over as many sequences as it takes. Other columns go; an empty table gives no rows.
    """
    path = path or vocabulary_path()
    arrow = OUT if with_ids else pa.schema(list(OUT)[:-1])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = shared_encoder(path), TaskContext.get().partitionId() << 40
        for part in chunks(batches, text, RUN):
            each = encoder.encode(part.column(text).to_pylist())
            ids, sizes = np.concatenate(each), np.array([len(e) for e in each], np.int64)
            ends = np.cumsum(sizes)
            stops = np.array(cuts(len(ids), ends, np.flatnonzero(encoder.stop[ids]) + 1), np.int64)
            edges = np.unique(np.concatenate([[0], ends, stops]))
            lo, hi = edges[:-1], edges[1:]
            doc, seq = np.searchsorted(ends, lo, side="right"), np.searchsorted(stops, lo, side="right")
            begins = np.concatenate([[0], stops[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)]
            columns = [
                part.column(key).take(pa.array(doc)).cast(pa.int64()), pa.array(lo - (ends - sizes)[doc]), pa.array(hi - lo), pa.array(crc, pa.int64()),
                pa.array(sizes[doc]), pa.array(sequence + seq), pa.array(lo - begins[seq]),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
            sequence += len(stops)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    kind = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, kind)

"""Language identification of whole, possibly mixed texts.

Words are runs of letters. The script ranges of a word's characters leave the languages that use them; each of these
scores the word by its hashed byte trigrams, and a Viterbi pass with a penalty for switching labels the words. Runs of
one label are the spans; the language with most letters in spans is the text's.

The model is trained on all labelled rows it is given: a table of ``GRAMS`` counts a language, whatever the corpus.
Null texts and texts without a letter are ``und`` with score 0. Texts whose letters fit no learned language's scripts
get the commonest language with score 0. Rows with a null label are not learned from. Ties go to the smaller label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.blocks import chunks, text_buffer, tidy
from tessera.llm.words import LOWER, split

GRAMS, SWITCH, SCRIPT_SHARE, UNKNOWN, SPAN = 1 << 16, 12.0, 0.01, "und", 1024
#: Bytes of text that are labelled at a time; a longer text is one step of its own.
CHUNK = 1 << 20
#: A word's evidence is bounded, so that one odd word does not outweigh a sentence.
WORD_BOUND = 30.0

# Scripts by the lead byte of a character's UTF-8 form, which fixes its range of code points.
SCRIPT = np.zeros(256, np.uint16)
SCRIPT[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCB)]] = 1 << 0  # Latin
SCRIPT[[0xCD, 0xCE, 0xCF]] = 1 << 1  # Greek
SCRIPT[range(0xD0, 0xD5)] = 1 << 2  # Cyrillic, Armenian
SCRIPT[[0xD6, 0xD7]] = 1 << 3  # Hebrew
SCRIPT[range(0xD8, 0xDE)] = 1 << 4  # Arabic, Syriac
SCRIPT[[0xDE, 0xDF, 0xE0]] = 1 << 5  # Indic, Thai
SCRIPT[0xE1] = 1 << 6  # Georgian, Ethiopic, Khmer
SCRIPT[0xE3] = 1 << 7  # Kana
SCRIPT[range(0xE4, 0xEA)] = 1 << 8  # Han
SCRIPT[range(0xEA, 0xEE)] = 1 << 9  # Hangul
SCRIPT[0xF0] = 1 << 10  # beyond the basic plane
BREAK = SCRIPT == 0
BREAK[range(0x80, 0xC0)] = False  # continuation bytes follow their lead byte, see _letters
BREAK[[0xCB, 0xCC]] = False  # modifiers and combining marks


def _letters(data: np.ndarray) -> np.ndarray:
    """The bytes with whatever is no letter as a space: ASCII signs and digits, and characters led by C2, E2, EE or EF."""
    out = LOWER[data].copy()
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    out[upper] += 0x20
    for lead, size in ((0xC2, 2), (0xE2, 3), (0xEE, 3), (0xEF, 3)):
        at = np.flatnonzero(data == lead)
        for k in range(size):
            out[np.minimum(at + k, len(out) - 1)] = 0x20
    out[BREAK[out]] = 0x20
    return out


_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, trigram numbers by position, word starts, ends, documents)."""
    text = _letters(data) if len(data) else data
    starts, ends, doc = split(text, offsets, _SPACE)
    wide = np.concatenate([[0x20], text, [0x20]]).astype(np.uint32)
    before, after = wide[:-2], wide[2:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[heads] = 0x20
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[tails] = 0x20
    grams = (before * np.uint32(0x9E3779B1) ^ text.astype(np.uint32) * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)) >> np.uint32(3)
    grams = (grams * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    return text, grams.astype(np.int64), starts, ends, doc


@dataclass
class Model:
    """langs: labels in order; logp: (GRAMS, L) log-likelihoods; scripts: what each language uses; common: the commonest's number."""

    langs: list[str]
    logp: np.ndarray
    scripts: np.ndarray
    common: int


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts trigrams and scripts of every labelled row; partial sums are at most GRAMS a language and task."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text", CHUNK):
            data, offsets = text_buffer(part.column("text"))
            text_, grams, _, _, _ = _features(data, offsets)
            labels, number = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            of = np.repeat(number, np.diff(offsets))
            word = text_ != 0x20
            for k, name in enumerate(labels.tolist()):
                own = of == k
                sums.setdefault(name, np.zeros(GRAMS + 17, np.int64))[:GRAMS] += np.bincount(grams[own & word], minlength=GRAMS)
                marks = SCRIPT[data[own]]
                sums[name][GRAMS : GRAMS + 16] += [int(np.count_nonzero(marks == 1 << b)) for b in range(16)]
                sums[name][GRAMS + 16] += int(np.count_nonzero(number == k))
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "gram": at, "n": s[at]})

    found = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(langs), GRAMS + 17))
    counts[[langs.index(x) for x in found["lang"].to_pylist()], found["gram"].to_numpy()] = found["n"].to_numpy()
    grams, marks, docs = counts[:, :GRAMS], counts[:, GRAMS : GRAMS + 16], counts[:, -1]
    logp = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * GRAMS))
    used = (marks >= SCRIPT_SHARE * np.maximum(1, marks.sum(axis=1, keepdims=True))) @ (1 << np.arange(16))
    return Model(langs, logp.T.astype(np.float64).copy(), used.astype(np.int64), int(np.argmax(docs)) if langs else 0)


def _within(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The or of the marks in each of the ranges, which are ascending and apart."""
    return np.bitwise_or.reduceat(np.append(marks, marks.dtype.type(0)), np.stack([starts, ends], 1).ravel())[::2]


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores by word and language, whether any language has the word's scripts, starts, ends, documents)."""
    _, grams, starts, ends, doc = _features(data, offsets)
    scores = np.zeros((len(starts), len(model.langs)))
    for k in range(len(model.langs)):
        sums = np.concatenate([[0.0], np.cumsum(model.logp[grams, k])])
        scores[:, k] = sums[ends] - sums[starts]
    if not scores.size:  # no word, or no language learned
        return scores, np.zeros(len(starts), bool), starts, ends, doc
    scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -WORD_BOUND)
    script = _within(SCRIPT[data], starts, ends).astype(np.int64)
    fits = (script[:, None] & ~model.scripts[None, :]) == 0
    known = fits.any(axis=1)
    scores[known[:, None] & ~fits] = -1e6
    scores[~known] = 0.0
    return scores, known, starts, ends, doc


def _forward(scores: np.ndarray, begin: np.ndarray, counts: np.ndarray, first: np.ndarray, switch: float, path: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Best totals by last label of runs of words that start at ``begin`` with totals ``first``, the longest run first; and where each step came from.

    All runs step together, so a step is a few array operations.
    """
    live = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")
    total, final = first.copy(), np.empty_like(first)
    stays, arg = (np.zeros(scores.shape, bool), np.zeros(len(scores), np.int8)) if path else (None, None)
    for t in range(1, int(counts[0])):
        m, was = live[t], live[t - 1]
        if m < was:
            final[m:was] = total[m:was]
            total = total[:m]
        at = begin[:m] + t
        top = total.argmax(axis=1)
        jump = total[np.arange(m), top] - switch
        if path:
            stays[at], arg[at] = total >= jump[:, None], top
        total = np.maximum(total, jump[:, None]) + scores[at]
    final[: len(total)] = total
    return final, stays, arg


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH, span: int = SPAN) -> np.ndarray:
    """The best label of each word. No loop is longer than ``span`` or the number of spans in the longest text.

    A text of more words is cut into spans. What each span adds from any label before it to any label at its end makes a matrix; these
    are chained from span to span (a maximum of sums), which gives the labels at the cuts. Then all spans are labelled at once.
    """
    n_langs = scores.shape[1]
    if not len(doc) or n_langs == 1:
        return np.zeros(len(doc), np.int64)
    words = np.bincount(doc, minlength=n_docs)
    per_doc = -(-words // span)
    owner = np.repeat(np.arange(n_docs), per_doc)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    begin = (np.cumsum(words) - words)[owner] + nth * span
    counts = np.minimum(span, words[owner] - nth * span)
    order = np.argsort(-counts, kind="stable")
    entry, leave = np.full(len(owner), -1), np.full(len(owner), -1)
    enter = np.where(np.eye(n_langs, dtype=bool), 0.0, -switch)
    cut = np.flatnonzero(per_doc > 1)
    if len(cut):
        inner = order[(nth > 0)[order]]  # spans behind another one
        rows = np.repeat(inner, n_langs)
        gains = np.empty((len(owner), n_langs, n_langs))
        gains[inner] = _forward(scores, begin[rows], counts[rows], np.tile(enter, (len(inner), 1)) + scores[begin[rows]], switch, False)[0].reshape(-1, n_langs, n_langs)
        heads = (np.cumsum(per_doc) - per_doc)[cut]
        heads = heads[np.argsort(-per_doc[cut], kind="stable")]
        size = per_doc[owner[heads]]
        value = _forward(scores, begin[heads], counts[heads], scores[begin[heads]], switch, False)[0]
        came = np.zeros((len(owner), n_langs), np.int64)
        ends = np.empty(len(heads), np.int64)
        for j in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -(j + 1), side="right"))
            both = value[:m, :, None] + gains[heads[:m] + j]
            came[heads[:m] + j] = both.argmax(axis=1)
            value[:m] = both.max(axis=1)
        ends = value.argmax(axis=1)
        for j in range(int(size[0]) - 1, 0, -1):
            m = int(np.searchsorted(-size, -(j + 1), side="right"))
            at = heads[:m] + j
            leave[at] = ends[:m]
            ends[:m] = came[at, ends[:m]]
            entry[at] = ends[:m]
        leave[heads] = ends
    first = scores[begin] + np.where((entry >= 0)[:, None], enter[entry], 0.0)
    final, stays, arg = _forward(scores, begin[order], counts[order], first[order], switch, True)
    now = np.where(leave[order] >= 0, leave[order], final.argmax(axis=1))
    live = np.searchsorted(-counts[order], -np.arange(1, counts[order[0]] + 1), side="right")
    labels = np.zeros(len(doc), np.int64)
    for t in range(int(counts[order[0]]) - 1, -1, -1):
        m = live[t]
        at = begin[order[:m]] + t
        label = now[:m]
        labels[at] = label
        if t:
            now[:m] = np.where(stays[at, label], label, arg[at])
    return labels


RESULT = "lang_pred string, score double"
SPANS = "lang_spans array<struct<lang:string,start:bigint,stop:bigint>>"


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (the share of letters that are labelled so) and, if asked for, the spans in bytes.

    Columns that have a result's name are replaced, others pass through, ids of any kind; the text goes unless ``keep_text``. Texts of
    any length are labelled whole. Repeated rows stay; an empty table gives no rows, and a model of no language labels all ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = StructType.fromDDL(RESULT + (", " + SPANS if spans else ""))
    own = StructType([f for f in docs.schema.fields if f.name not in result.names and (keep_text or f.name != text)])
    schema = StructType([*own.fields, *result.fields])
    arrow = to_arrow_schema(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in chunks(batches, text, CHUNK):
            column = part.column(text)
            data, offsets = text_buffer(column)
            n = part.num_rows
            scores, known, starts, ends, doc = word_scores(m, data, offsets)
            labels = viterbi(scores, doc, n) if m.langs else np.zeros(len(doc), np.int64)
            size = (ends - starts) * known
            weight = np.zeros((n, max(1, len(m.langs))))
            np.add.at(weight, (doc, labels), size)
            best, total = weight.argmax(axis=1), weight.sum(axis=1)
            share = np.divide(weight.max(axis=1), total, out=np.zeros(n), where=total > 0)
            plain = np.zeros(n, bool)  # has an ASCII letter, hence a letter
            if len(starts):
                plain[doc[_within(_ASCII[data], starts, ends)]] = True
            names: list[str] = []
            for k in range(n):
                if not plain[k] and not (m.langs and any(c.isalpha() for c in column[k].as_py() or "")) or not m.langs:
                    names.append(UNKNOWN)
                    share[k] = 0.0
                else:
                    names.append(m.langs[best[k] if total[k] else m.common])
            made = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(share)}
            if spans:
                made["lang_spans"] = pa.array(_spans(m.langs, labels, known, starts - offsets[doc], ends - offsets[doc], doc, n), arrow.field("lang_spans").type)
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, schema)


_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _spans(langs, labels, known, starts, ends, doc, n) -> list[list[dict]]:
    """Runs of equal labels in each document; words of unknown script are in none."""
    out: list[list[dict]] = [[] for _ in range(n)]
    label = np.where(known, labels, -1)
    if not len(label):
        return out
    new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
    for a, z in zip(new.tolist(), np.append(new[1:], len(label)).tolist(), strict=True):
        if label[a] >= 0:
            out[doc[a]].append({"lang": langs[label[a]], "start": int(starts[a]), "stop": int(ends[z - 1])})
    return out

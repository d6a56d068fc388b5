"""Each operator against a brute-force version or a round trip, with the odd cases its docstring defines."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import DATA
from oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import blocks, context_tree, decontaminate, language, packing, permutation_index, preference, queries, resemblance, simhash, substring_dedup, url_filter, warc
from tessera.llm.suffix_array import shared_windows, suffix_array

SMALL = f"{DATA}/sf0.001"
ODD = "doc_id long, text string, n_bytes string, fingerprint int, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated texts, repeated and null ids, and a column that has a result's name."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the very old house on the hill "
    rows = [(1, base, "x", 1, "en"), (2, "zz " + base, None, 2, "en"), (3, None, "y", None, None), (4, "", "z", 3, "en"), (2, base, "w", 4, "fr"), (None, base, "v", 5, "en"), (5, "x" * 5000, "u", 6, "de"), (6, "x" * 300 + " é" * 50, "t", 7, "de"), (7, "123 !!", "s", 8, "de")]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SMALL)


def test_suffix_array_sorts():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert [sorted(c) for c in shared_windows([b"abcd", b"xbcd", b"bcd"], 3)] == [[(0, 1), (1, 1), (2, 0)]]


def brute_repeats(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - width + 1):
                s = b[p : p + width]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, odd):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = substring_dedup.remove_repeats(odd)
    assert set(odd.columns) - {"n_bytes"} <= set(got.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == brute_repeats([(r.doc_id, r.text) for r in odd.collect()], 50)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.remove_repeats(df, width=9).select(columns).collect()), key=repr) == brute_repeats(rows, 9)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, queries.QUERIES["op6_suffix_array_dedup"](spark, SMALL).select(columns).collect()), key=repr) == brute_repeats(list(map(tuple, docs.collect())), 50)


def slow_fingerprint(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(fps, most=2):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= most:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted([(i, f"{f:016x}", least.get(root(k))) for k, (i, f) in enumerate(fps)], key=repr)


def test_simhash(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for df in (odd, docs):
        got = sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
        assert got == slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_links_lose_nothing(monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    near = [b ^ np.uint64((1 << int(i)) | (1 << int(j))) for b in base for i, j in rng.integers(0, 64, (6, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    import pyarrow as pa

    posts = list(simhash._posts(1)(iter([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])])))
    keys, own = (np.concatenate([np.frombuffer(x, np.uint64) for p in posts for x in p.column(c).to_pylist()]) for c in (1, 2))
    got = {tuple(sorted(x)) for a, b in simhash.linked_pairs(keys, own) for x in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 2}
    assert got == want


def test_large_groups_are_split(monkeypatch):
    rng = np.random.default_rng(12)
    fps = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, fps[:500] ^ np.uint64(1 << 40), fps[:300] ^ np.uint64(3)]))
    got = {tuple(sorted(x)) for a, b in simhash.linked_pairs(np.zeros(len(fps), np.uint64), fps) for x in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert got == {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def test_simhash_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "keep", 9), (2, "A b c d", "me", 8), (3, "long words " * 100000, "too", 7)], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert [got[i].fp for i in (1, 2, 3)] == ["keep", "me", "too"] and got[2].component_id == 1
    assert got[3].fingerprint == f"{slow_fingerprint('long words ' * 100000):016x}"


def test_blocks_stay_where_they_are(spark):
    ids = np.array([0, 1, 7, 1 << 32, (5 << 32) + 123, (1 << 40) + 5])
    want = [r[0] for r in spark.createDataFrame([(int(i),) for i in ids], "id long").selectExpr("pmod(hash(id), 211)").collect()]
    assert blocks.bucket_of(ids, 211).tolist() == want
    df = spark.createDataFrame([(i, "text " * 10) for i in range(100)], "doc_id long, text string").repartition(3)
    table = blocks.write_blocks(df)
    assert table.selectExpr("sum(n_rows)").first()[0] == 100 and len(table.inputFiles()) == 3
    for task in (0, 3, 50):
        own = np.array([x for x, _ in zip(blocks.task_ids(task, 13), range(20), strict=False)])
        assert len(set(own.tolist())) == 20 and (own >> 32 == task).all() and np.bincount(blocks.bucket_of(own, 13)).max() == 5
    told = table.groupBy("block_id").agg(F.collect_list("n_rows").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.select("block_id", "payload").join(told.withColumn("x", F.rand()), "block_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def slow_resembling(rows):
    """Groups of ids whose texts' sets of five-word shingles are chained by resemblances of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders, group = collections.defaultdict(list), list(range(len(rows)))
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x]) if s else {j: 0 for j in range(i) if not sets[j]}
        for x in s:
            holders[x].append(i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    found = collections.defaultdict(set)
    for (i, _), g in zip(rows, group, strict=True):
        found[g].add(i)
    return sorted(map(sorted, found.values()))


def test_near_copies_beyond_leaders(spark):
    """Chains whose ends are unlike, and a cloud around a text that itself is missing: links that no group's leader shows."""
    rng = random.Random(16)
    rows, words = [], [f"w{rng.randint(0, 999)}" for _ in range(120)]
    for k in range(40):
        rows.append((k, " ".join(words)))
        words[rng.randrange(120)] = f"x{k}"
    centre = [f"v{rng.randint(0, 999)}" for _ in range(200)]
    for k in range(60):
        at = set(rng.sample(range(200), rng.randint(1, 6)))
        rows.append((100 + k, " ".join(f"y{k}" if j in at else w for j, w in enumerate(centre))))
    found = collections.defaultdict(list)
    for r in resemblance.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        found[r.component].append(r.doc_id)
    assert sorted(map(sorted, found.values())) == slow_resembling(rows)


def test_near_copies_by_fingerprint(spark):
    """A pair at 0.8 that shares no band and that only a wide link joins, and one too far for wide links that only bands join."""

    def pair(seed):
        w = [f"{seed}a{k}" for k in range(24)]
        return " ".join(w[:22]), " ".join(w[:20] + w[22:])

    bits = lambda a, b: np.bitwise_count(simhash.majority(resemblance.shingles(a)) ^ simhash.majority(resemblance.shingles(b)))
    shared = lambda a, b: set(resemblance.band_keys(resemblance.shingles(a)).tolist()) & set(resemblance.band_keys(resemblance.shingles(b)).tolist())
    near, far = pair(14147), next(p for p in map(pair, range(100)) if bits(*p) > 8 and shared(*p))
    assert bits(*near) <= 8 and not shared(*near)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*near, *far, "five words of no copy", "a b c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()) == [0, 2, 4, 5]


def test_wide_components(spark):
    """Classes by brute force, of pairs at each number of bits, a chain, and a cloud of more than are compared pair by pair."""
    rng = np.random.default_rng(17)
    turned = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    fps = rng.integers(0, 1 << 64, 400, dtype=np.uint64).tolist()
    for n in (1, 2, 5, 7, 8, 9, 10):
        fps += [int(turned(np.uint64(x), n)) for x in fps[40 * n - 40 : 40 * n]][:40]
    for _ in range(30):
        fps.append(int(turned(np.uint64(fps[-1]), 8)))
    centre = np.uint64(rng.integers(0, 1 << 63))
    fps += [int(turned(centre, int(n))) for n in rng.integers(1, 6, 3000)]
    known = np.unique(np.array(fps, np.uint64))
    keys = np.concatenate([simhash.wide_keys(known, np.full(len(known), k)) for k in range(67)])
    assert np.unique(keys, return_counts=True)[1].max() > simhash.LARGE
    label, todo = np.full(len(known), -1), list(range(len(known)))
    for k in todo:
        front = [k] if label[k] < 0 else []
        while front:
            x = front.pop()
            label[x] = k
            near = np.flatnonzero((np.bitwise_count(known ^ known[x]) <= simhash.WIDE_BITS) & (label < 0))
            label[near] = k
            front += near.tolist()
    want = sorted(sorted(known[label == k].view(np.int64).tolist()) for k in np.unique(label) if (label == k).sum() > 1)
    found = collections.defaultdict(list)
    for r in simhash.wide_components(spark.createDataFrame([(x,) for x in known.view(np.int64).tolist()], "fp long")).collect():
        found[r.component].append(r.fp)
    assert sorted(map(sorted, found.values())) == want


def test_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 999)}" for _ in range(100)]
    edited = lambda *at: " ".join("new" if k in at else w for k, w in enumerate(base))
    made = [(900001, " ".join(base)), (900002, edited(50)), (900003, edited(20, 50)), (900004, edited(10, 30, 50, 70, 90)), (900005, edited(0, 50, 99)), (900006, "a few words"), (900007, "A few  words"), (900008, None), (900009, " ")]
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rows = list(map(tuple, docs.collect())) + made
    found = collections.defaultdict(list)
    for r in resemblance.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.component].append(r.doc_id)
    assert sorted(map(sorted, found.values())) == slow_resembling(rows)
    assert resemblance.near_copies(docs.limit(0)).count() == 0
    own = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in made[:5]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, own, SMALL).collect()) == [900001, 900004]


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(10, "quick brown fox jumps over the lazy dog and runs away"), (9, "Lazy DOG"), (8, None), (7, "??"), (10, "lazy dog"), (None, "old house")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(odd, items).collect()}
    hit = got[(1, 20)]
    assert (hit.n_hit, hit.n_items, hit.contaminated) == (13, 2, True) and hit.items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert got[(3, 0)].n_hit == 0 and got[(3, 0)].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd.limit(0), items).count() == 0
    index = decontaminate.build_index(odd)
    near = decontaminate.proximity_matches(index, ["fox", "dog"], 8).collect()
    assert {(r.doc_id, r.first, r.last) for r in near} >= {(1, 3, 8), (2, 4, 9)}
    assert decontaminate.proximity_matches(index, ["fox", "dog"], 5).count() == 0


def test_proximity_is_exact(spark):
    rng = random.Random(10)
    texts = ["b x x a x x x b c", *(" ".join(rng.choice("abcdxxxxxx") for _ in range(rng.randint(0, 60))) for _ in range(40)), "a " + "x " * 90 + "b", "c", "d"]
    index = decontaminate.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1))
    for words, within in ((["a", "b", "c"], 5), (["a", "b", "c", "d"], 9), (["a", "b"], 100), (["c", "d", "a"], 300)):
        totals = [sum(t.split().count(w) for t in texts) for w in words]
        rarest, want = words[totals.index(min(totals))], set()
        for d, t in enumerate(texts):
            w = t.split()
            for p in (k for k, x in enumerate(w) if x == rarest):
                sizes = [b - a for a in range(p + 1) for b in range(p, min(len(w), a + within)) if set(words) <= set(w[a : b + 1])]
                want |= {(d, p, min(sizes))} if sizes else set()
        got = decontaminate.proximity_matches(index, words, within).collect()
        assert len(got) == len(want) > 0
        for r in got:
            assert set(words) <= set(texts[r.doc_id].split()[r.first : r.last + 1])
        assert collections.Counter((r.doc_id, r.last - r.first) for r in got) == collections.Counter((d, n) for d, _, n in want)


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    got = {(r.doc_id, r.n_bytes): r for r in language.identify(odd, model, spans=True).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in ((3, "y"), (4, "z"), (7, "s")))
    assert language.identify(odd.limit(0), model).count() == 0
    assert language.identify(odd, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    mixed = "The and of with thtion erhea. Ungschheit der die enver erkeit und nicht die ein."
    (row,) = language.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).collect()
    assert [s.lang for s in row.lang_spans] == ["en", "de"]


def test_language_accuracy(spark):
    d = f"{DATA}/sf0.01"
    found = queries.QUERIES["op2_language_viterbi"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


@pytest.mark.parametrize("span", [language.SPAN, 3, 2])
def test_viterbi_is_best(span):
    rng = np.random.default_rng(4)
    scores, doc = rng.normal(0, 5, (12, 3)), np.array([0] * 7 + [2] * 5)
    got = language.viterbi(scores, doc, 3, switch=4.0, span=span)
    value = lambda s, p: s[np.arange(len(p)), p].sum() - 4.0 * (np.diff(p) != 0).sum()
    for own in (doc == 0, doc == 2):
        s, n = scores[own], own.sum()
        best = max(value(s, np.array(np.unravel_index(k, (3,) * n))) for k in range(3**n))
        assert value(s, got[own]) == pytest.approx(best)


def test_viterbi_in_spans():
    rng = np.random.default_rng(13)
    sizes = rng.integers(0, 400, 30)
    doc = np.repeat(np.arange(30), sizes)
    scores = rng.normal(0, 3, (len(doc), 4))
    whole = language.viterbi(scores, doc, 30)
    for span in (1, 7, 64, 399):
        assert (language.viterbi(scores, doc, 30, span=span) == whole).all()


def slow_language(train_rows, texts):
    """Training, scripts, scores and labels word by word, over the same hashed trigrams."""
    word = re.compile("[^\\W\\d_]+")

    def grams(w):
        b = b" " + w.lower().encode() + b" "
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            g = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
            yield ((g >> 3) * 0x27D4EB2F & 0xFFFFFFFF) >> 16

    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in train_rows:
        docs[lang] += 1
        for w in word.findall(text):
            counts[lang].update(grams(w))
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) for k in langs}
    logp = lambda k, g: math.log((counts[k][g] + 0.5) / (total[k] + 0.5 * language.GRAMS))
    out = []
    for text in texts:
        words = word.findall(text or "")
        if not words:
            out.append(("und", 0.0))
            continue
        scores = np.array([[sum(logp(k, g) for g in grams(w)) for k in langs] for w in words])
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -language.WORD_BOUND)
        value, back = scores[0].copy(), []
        for s in scores[1:]:
            step = np.where(np.eye(len(langs), dtype=bool), value[:, None], value[:, None] - language.SWITCH)
            back.append(step.argmax(axis=0))
            value = step.max(axis=0) + s
        labels = [int(value.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        weight = np.zeros(len(langs))
        for w, k in zip(words, reversed(labels), strict=True):
            weight[k] += len(w.encode())
        out.append((langs[int(weight.argmax())], weight.max() / weight.sum()))
    return out


def test_language_query_by_hand(spark):
    """op2's query on a whole table against a word-by-word version: folds, training, scores and shares."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    want = slow_language([(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and not fold[r.doc_id]], [r.text for r in rows])
    got = {r.doc_id: r for r in queries.QUERIES["op2_language_viterbi"](spark, SMALL).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == f for i, f in fold.items())
    same = [(got[r.doc_id].lang_pred, got[r.doc_id].score) for r in rows]
    assert [x[0] for x in same] == [x[0] for x in want] and [x[1] for x in same] == pytest.approx([x[1] for x in want], abs=1e-9)


def test_language_long_and_clashing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    long = "the and of with that from " * 60000 + "und nicht die der auch werden " * 60000
    df = spark.createDataFrame([(None, long, "x", 1.5), (1, "the", "y", None), (1, "the", "y", None)], "doc_id long, text string, lang_pred string, score double")
    got = language.identify(df, model, spans=True).collect()
    assert len(got) == 3 and [s.lang for s in next(r for r in got if r.doc_id is None).lang_spans] == ["en", "de"]


def slow_tree(training, texts, depth=context_tree.DEPTH):
    counts = collections.defaultdict(lambda: [0, 0])

    def bits(t):
        p = bytes(depth) + t + b"\0"
        for i in range(depth, len(p)):
            node = 1
            for b in range(7, -1, -1):
                yield p[i - depth : i], node, p[i] >> b & 1
                node = 2 * node + (p[i] >> b & 1)

    for t in training:
        for c, node, bit in bits(t):
            for d in range(depth + 1):
                counts[(c[depth - d :], node)][bit] += 1
    deeper = collections.defaultdict(set)
    for c, node in counts:
        if c:
            deeper[(c[1:], node)].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    def weighted(c, node):
        e = kt(*counts[(c, node)])
        return e if len(c) == depth else np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(weighted(k, node) for k in deeper[(c, node)]))

    known, out = {c for c, _ in counts}, []
    for t in texts:
        total = 0.0
        for c, node, bit in bits(t):
            mixed, share = 0.0, 1.0
            for d in range(depth + 1):
                own = c[depth - d :]
                if own not in known:
                    break
                a, b = counts.get((own, node), (0, 0))
                w = 1.0 if d == depth else math.exp(math.log(0.5) + kt(a, b) - weighted(own, node)) if (own, node) in counts else 0.5
                mixed, share = mixed + share * w * (b + 0.5) / (a + b + 1), share * (1 - w)
            p = mixed + share * 0.5
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("lot", [context_tree.LOT, 1])
def test_context_tree(spark, monkeypatch, lot):
    monkeypatch.setattr(context_tree, "LOT", lot)
    training, texts = ["abracadabra abra", "banana band", ""], ["abba bandana", "", None, "xyz"]
    rows = [(i, t, True) for i, t in enumerate(training)] + [(9 + i, t, False) for i, t in enumerate(texts)] + [(20, "unused", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(4)
    got = {r.doc_id: r for r in context_tree.score_texts(df, df["learn"]).collect()}
    want = slow_tree([t.encode() for t in training], [(t or "").encode() for t in texts])
    assert [got[9 + i].score for i in range(4)] == pytest.approx(want, rel=1e-9)
    assert got[9].train_tokens == 4 + 3 and (got[9].n_tokens, got[9].n_known) == (3, 1)
    assert got[9].base_score == pytest.approx(2 * math.log10(1 / 13) + math.log10(4 / 13))  # N = 7, V = 5
    assert context_tree.score_texts(df.limit(0), df["learn"]).count() == 0


def test_context_tree_odd(spark):
    df = spark.createDataFrame([(1, "ab ab", True, "x", 3), (1, "ab ab", True, "y", 4), (None, "word " * 300000, False, "z", 5), (2, None, False, None, None)], "doc_id long, text string, learn boolean, score string, n_known int")
    got = context_tree.score_texts(df, df["learn"]).collect()
    assert len(got) == 4 and {r.n_tokens for r in got if r.doc_id == 1} == {3} and next(r for r in got if r.doc_id is None).n_tokens == 300001
    assert all(r.train_tokens == 6 and r.score < 0 for r in got)
    none = context_tree.score_texts(df, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.base_score for r in none} == {0.0}
    assert next(r for r in none if r.doc_id == 1).score == pytest.approx(6 * 8 * math.log10(0.5))


def test_context_tree_beats_words(spark):
    got = queries.QUERIES["op7_context_tree_weighting"](spark, f"{DATA}/sf0.1").where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_packing(spark, odd):
    rows = packing.pack(odd).collect()
    tokenizer = packing.Encoder(packing.vocabulary_path()).tokenizer
    want = sorted([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd.collect())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        assert sum(n for _, n in s) <= packing.SIZE
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(s), sorted(s)[1:], strict=False)) and min(s)[0] == 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            pieces[len(pieces)] = []
        pieces[len(pieces) - 1] += r.ids
    assert sorted(pieces.values()) == want
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_query_on_a_table(spark):
    """op8's query on a whole table: the tokenizer's own ids, gapless sequences, little padding."""
    d = f"{DATA}/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    tokenizer = packing.Encoder(packing.vocabulary_path()).tokenizer
    ids = {i: [*e.ids, 1] for i, e in zip(docs, tokenizer.encode_batch([t or "" for t in docs.values()], add_special_tokens=False), strict=True)}
    rows = queries.QUERIES["op8_order_preserving_packing"](spark, d).collect()
    reached, sequences = dict.fromkeys(docs, 0), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert reached[r.doc_id] == r.start and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        reached[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert reached == {i: len(x) for i, x in ids.items()}
    used = held = 0
    for s in sequences.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *s], [*s, (sum(n for _, n in s), 0)], strict=True))
        total = s[-1][0] + s[-1][1]
        used, held = used + total, held + (total if total & (total - 1) == 0 else 2048)
        assert total <= 2048
    assert 1 - used / held < 0.015


def test_cuts_are_best():
    rng = random.Random(5)
    for _ in range(20):
        total, size = rng.randint(200, 400), 128
        docs = sorted({*(rng.randint(1, total) for _ in range(4)), total})
        ends = sorted({rng.randint(1, total) for _ in range(30)})
        cost = {0: 0, total: 0} | {e: packing.SENTENCE_COST for e in ends} | dict.fromkeys(docs, 0)
        got = packing.cuts(total, np.array(docs), np.array(ends), size)
        price = lambda stops: sum((0 if b - a in (64, 128) else size - (b - a)) + packing.SEQUENCE_COST + cost.get(b, packing.HARD_COST) for a, b in zip([0, *stops], stops, strict=False))
        best = [0] + [math.inf] * total
        for b in range(1, total + 1):
            for a in range(max(0, b - size), b):
                if a in cost and b in cost:
                    best[b] = min(best[b], best[a] + price([b]) - price([]) if a == 0 else best[a] + (0 if b - a in (64, 128) else size - (b - a)) + packing.SEQUENCE_COST + cost[b])
        assert price(got) <= best[total] and got[-1] == total and max(np.diff([0, *got])) <= size


def test_encoder_equals_tokenizer():
    e = packing.Encoder(packing.vocabulary_path())
    texts = ["İstanbul ΣΑΣ <|endoftext|> x", "é e\u0301 ª²¼ it's I'LL they're''s a'dfoo ...!!?", "x\x0by\x85z\xa0q", "", None, "汉字 123 ½", "ß ÿ ſ Ĳ", "a" * 300]
    assert [list(a[:-1]) for a in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def recall(spark, d):
    """Of the 20 nearest by brute force, what the query finds; asserts that scores and ranks are exact."""
    got = queries.QUERIES["op4_permutation_index"](spark, d).toPandas()
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    m, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    q = np.flatnonzero(ids % 20 == 0)
    s = m[q] @ m.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    found = got.groupby("query_id").vec_id.apply(set)
    assert (got.groupby("query_id").size() == 20).all() and len(got) == 20 * len(q)
    row = {i: m[k] for k, i in enumerate(ids)}
    for x in got.sample(200, random_state=1).itertuples():
        assert x.score == pytest.approx(row[x.query_id] @ row[x.vec_id], abs=1e-12)
    assert (got.sort_values(["query_id", "rank"]).groupby("query_id").score.diff().fillna(0) <= 0).all()
    return np.mean([len(found[ids[a]] & set(ids[b])) / 20 for a, b in zip(q, top, strict=True)])


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1", "check_l"])
def test_permutation_index(spark, size):
    assert recall(spark, f"{DATA}/{size}") >= 0.9


def test_permutation_index_copies(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32))
    m = centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 32))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    m[rng.permutation(6000)[:2000]] = m[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(1)
    found = permutation_index.search(df, df.where("vec_id % 20 = 0")).toPandas().groupby("query_id").vec_id.apply(set)
    e, recall = m.astype(float), []
    for i in range(0, 6000, 20):
        s = permutation_index.exact(e, e[i])
        best = [j for j in np.lexsort((np.arange(6000), -s)).tolist() if j != i][:20]
        recall.append(((m[i] == m[0]).all(), len(found[i] & set(best)) / 20))
    assert np.mean([r for copy, r in recall if copy]) == 1 and np.mean([r for copy, r in recall if not copy]) >= 0.9


@pytest.mark.parametrize("sigma", [0.3, 0.6, 1.0])
def test_permutation_index_norms(spark, sigma):
    e = np.array(spark.read.parquet(f"{DATA}/check_s/embeddings.parquet").toPandas().embedding.tolist(), float)
    e *= np.exp(sigma * np.random.default_rng(4).normal(size=len(e)))[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(e)), "embedding": e.tolist()})).repartition(4)
    found = permutation_index.search(df, df.where("vec_id % 20 = 0")).toPandas().groupby("query_id").vec_id.apply(set)
    s = e[::20] @ e.T
    s[np.arange(len(s)), np.arange(0, len(e), 20)] = -np.inf
    assert np.mean([len(found[20 * k] & set(best)) / 20 for k, best in enumerate(np.argsort(-s, axis=1)[:, :20].tolist())]) >= 0.9


def test_permutation_index_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in permutation_index.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 2, 0.5)]
    again = spark.createDataFrame([*rows, (0, [1.0, 0.0]), (0, [0.0, 2.0]), (8, [1.0]), (9, [3.0, 0.0, 0.0])], "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "7 AS rank")
    got = permutation_index.search(again, again.where("vec_id = 0")).orderBy("query_id", "rank").collect()
    ours = [(r.rank, r.vec_id, r.score) for r in got if r.score != 0]
    # Two equal rows with id 0: each finds the other, and the third row with that id is a candidate like any other.
    assert ours.count((1, 0, 1.0)) == 2 and {r.vec_id for r in got} == {0, 1, 2, 7} and len(got) == 3 * 5
    assert permutation_index.search(df.limit(0), df.limit(0)).count() == 0


def test_warc_salvage():
    parts = [warc.record(i, f"http://x/{i}", b"<p>%d</p>" % i * 200, hashlib.sha1(b"<p>%d</p>" % i * 200).hexdigest(), None, False, len(b"<p>%d</p>" % i * 200)) for i in range(4)]
    for pack in (lambda b: b, gzip.compress):
        members = [pack(p) for p in parts]
        half = len(members[1]) * 2 // 3
        members[1] = members[1][:half] + b"\0\1\2" + members[1][half + 5 :]
        found = list(warc.salvage(b"".join(members)))
        assert [int(f[3]["x-page-id"]) for f in found if f[0] == "record"] == [0, 2, 3]
        at = len(members[0])
        assert [f[1:3] for f in found if f[0] == "gap"] == [(at, at + len(members[1]))]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk"))[0][:3] == ("gap", 0, 4)


def test_warc_salvage_mixed():
    ids = lambda data: [int(f[3]["x-page-id"]) for f in warc.salvage(data) if f[0] == "record"]
    gaps = lambda data: [f[1:3] for f in warc.salvage(data) if f[0] == "gap"]
    parts = [made(i, gzip.compress(b"<p>%d</p>" % i * 50)) for i in range(4)]
    broken = b"XARC" + parts[0][4:]
    assert ids(broken + b"".join(parts[1:])) == [1, 2, 3] and gaps(broken + b"".join(parts[1:])) == [(0, len(broken))]
    mixed = parts[0] + gzip.compress(parts[1]) + b"junk" + parts[2] + gzip.compress(b"") + gzip.compress(parts[3])
    at = len(parts[0]) + len(gzip.compress(parts[1]))
    assert ids(mixed) == [0, 1, 2, 3] and gaps(mixed) == [(at, at + 4)]
    assert ids(broken + gzip.compress(parts[1]) + parts[2]) == [1, 2]


def made(i, payload=None):
    payload = b"<p>%d</p>" % i * 200 if payload is None else payload
    return warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None, False, len(payload))


def ids_and_gaps(data):
    found = list(warc.salvage(data))
    places = [f[1:3] for f in found]
    assert places == sorted(places)
    return [int(f[3]["x-page-id"]) for f in found if f[0] == "record"], [f[1:3] for f in found if f[0] == "gap"]


def test_warc_versions_and_digests():
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html>" + b"x" * 50
    page = body.partition(b"\r\n\r\n")[2]
    b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()

    def foreign(payload_digest, block_digest, version="1.1", content=body):
        head = f"WARC/{version}\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nX-Page-ID: 5\r\nWARC-Payload-Digest: {payload_digest}\r\nWARC-Block-Digest: {block_digest}\r\nContent-Length: {len(content)}\r\n\r\n"
        return head.encode() + content + b"\r\n\r\n"

    right = foreign(f"sha1:{b32(page)}", f"sha1:{b32(body)}")
    assert ids_and_gaps(right + made(1)) == ([5, 1], [])
    (found,) = [f for f in warc.salvage(gzip.compress(right)) if f[0] == "record"]
    assert warc.payload_of(found[3], found[4]) == page and warc.hex_digest(found[3]["warc-payload-digest"]) == ("sha1", hashlib.sha1(page).hexdigest())
    assert ids_and_gaps(foreign(f"sha256:{hashlib.sha256(page).hexdigest()}", "blake9:zz", "1.0")) == ([5], [])
    for bad in (foreign(f"sha1:{b32(body)}", f"sha1:{b32(body)}"), foreign(f"sha1:{b32(page)}", f"sha1:{b32(page)}"), foreign("md5:00", "x:y"), right.replace(b"WARC/1.1", b"WARC/2.0")):
        assert ids_and_gaps(bad + made(1)) == ([1], [(0, len(bad))])
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"
    assert ids_and_gaps(foreign(f"sha1:{b32(b'abcde')}", f"sha1:{b32(chunked)}", content=chunked)) == ([5], [])


def test_warc_damaged_member():
    rng = random.Random(11)
    noise = lambda: bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    records = [made(i, noise()) for i in range(200)]
    one, more = gzip.compress(b"".join(records)), gzip.compress(made(900))
    for at, junk in ((0.3, b"\0" * 400), (0.9, b"\0" * 400), (0.5, b"~")):
        lo = int(len(one) * at)
        got, gaps = ids_and_gaps(one[:lo] + junk + one[lo + len(junk) :] + more + made(901))
        kept = [i for i in got if i < 900]
        assert kept == sorted(set(kept)) and set(range(int(200 * at) - 12)) <= set(kept) and len(kept) < 200 and got[-2:] == [900, 901]
        assert gaps and gaps[0][0] <= lo + 1024 and gaps[-1][1] <= len(one) and gaps[0][1] > lo
    got, gaps = ids_and_gaps(one[: len(one) // 2] + more)  # cut short, and the next member right behind
    assert got[-1] == 900 and 85 < len(got) < 102 and gaps[0][1] == len(one) // 2
    bad = bytearray(one)
    bad[-6] ^= 1  # the checksum alone
    assert ids_and_gaps(bytes(bad))[0] == list(range(200))


def test_warc_drill(spark):
    rows = [(i, "u", "x" * (i * 40)) for i in range(100)] + [(None, None, None), (200, "u", "long " * 400000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'r' AS record_type", "1 AS revisit").repartition(3)
    found = warc.drill(df, lambda page: page is not None and page % 7 == 3).collect()
    assert sorted((r.page_id if r.page_id is not None else -1) for r in found if r.record_type != "gap") == [-1, *(i for i in range(100) if i % 7 != 3), 200]
    gaps = [r for r in found if r.record_type == "gap"]
    assert 1 <= len(gaps) <= 14 and all(r.stop > r.start and r.page_id is None for r in gaps)
    for path in {r.path for r in found}:
        spans = sorted({(r.start, r.stop) for r in found if r.path == path})
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert warc.drill(df.limit(0), lambda page: True).count() == 0


def test_warc_drill_damages_what_it_hits(spark, tmp_path):
    """With this page's middle byte changed, the member inflates to the same record: another match of equal content."""
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").where("page_id in (1, 230)")
    odd = spark.createDataFrame([(None, "u", "no id"), (-4, "u", "below zero")], "page_id long, url string, html string")
    pages.selectExpr("page_id + 64250 AS page_id", "url", "html").union(odd).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    compare(spark, queries.QUERIES["salvaged_archives"], queries.ORACLES["salvaged_archives"], str(tmp_path))


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "line\r\n\r\nWARC/1.0\r\n" * 90), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == 7 and (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 1200)
    assert (got[2].record_type, got[2].refers_to) == ("response", None) and got[None].refers_to == 2
    assert got[3].record_type == got[4].record_type == "response" and got[5].payload_bytes == 0 and got[6].record_type == "response"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_url_parts(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/7?x"), (2, None), (3, "no scheme"), (4, "http://com/en/"), (5, "http://xcom/en/"), (6, "a://b#c"), (7, "http://e.com:80?q://z/"), (8, "http://ÄB.net/de/\n8"), (9, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'old' as verdict")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.RULES).collect()}
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7", "allow") and got[4] == ("com", "/en/", "com/en/", "block")
    assert got[2] == got[3] == got[9] == ("", "", None, "allow") and got[5] == ("xcom", "/en/", None, "allow")
    assert got[6] == ("b", "", None, "allow") and got[7] == ("e.com:80", "", None, "allow") and got[8] == ("Äb.net", "/de/\n8", "net/de/", "allow")
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0 and url_filter.judge(df, []).where("rule is not null or verdict <> 'allow'").count() == 0


def slow_rule(host, path, rules):
    fit = [(-len(r), r, a) for a, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith(r[len(r.partition("/")[0]) :])]
    return min(fit)[1:] if fit else (None, "allow")


@pytest.mark.parametrize("most_bits", [url_filter.MAX_BITS, 64])
def test_rules_by_cascade(spark, monkeypatch, most_bits):
    monkeypatch.setattr(url_filter, "MAX_BITS", most_bits)
    monkeypatch.setattr(url_filter, "SHARD_BITS", 128)
    rules = [*queries.RULES, ("block", "com"), ("allow", "a.com/x"), ("block", "/only"), ("block", "b."), ("allow", "c.d.com/"), ("block", "c.d.com/e")]
    hosts = ["com", "a.com", "xa.com", "q.a.com", "b.", "", "c.d.com", "d.com", "com.", "example.com", "www.example.net"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x", "/xy", "/only", "/en/7", "/de/8" + "z" * 20000, "/e/f", "/de/")]
    df = spark.createDataFrame([*enumerate(urls), (3, urls[3]), (None, None), (None, urls[9])], "page_id long, url string").selectExpr("*", "'c' AS rule", "1 AS host")
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        rule, verdict = slow_rule(r.host, r.path, rules)
        assert (r.rule, r.verdict) == (rule, verdict), r.url


def test_cascade_decides(spark, monkeypatch):
    """Without its later filters the first one's errors come through; without the first nothing is listed."""
    df = spark.createDataFrame([(i, f"http://h{i}.org/") for i in range(4000)], "page_id long, url string")
    rules = [("block", f"h{i}.org/") for i in range(0, 4000, 5)]
    right = url_filter.judge(df, rules).where("verdict = 'block'").count()
    build = url_filter.build_cascade
    monkeypatch.setattr(url_filter, "build_cascade", lambda u, x: url_filter.Cascade(build(u, x).levels[:1]))
    assert right == 800 < url_filter.judge(df, rules).where("rule is not null").count()
    monkeypatch.setattr(url_filter, "build_cascade", lambda u, x: url_filter.Cascade([]))
    assert url_filter.judge(df, rules).where("rule is not null").count() == 0


def test_many_rules(spark):
    rules = spark.range(100000).selectExpr("if(id % 2 = 0, 'block', 'allow') AS action", "concat('h', id, '.org/p', id % 10) AS rule")
    pages = spark.range(50000, 150000).selectExpr("id AS page_id", "concat('https://www.h', id, '.org/p', id % 10, '/more') AS url")
    got = url_filter.judge(pages, rules).groupBy("verdict", F.col("rule").isNotNull().alias("r")).count().collect()
    assert {(x.verdict, x.r): x["count"] for x in got} == {("block", True): 25000, ("allow", True): 25000, ("allow", False): 50000}


@pytest.mark.parametrize("most_bits", [url_filter.MAX_BITS, 4096])
def test_cascade_is_exact(spark, monkeypatch, most_bits):
    monkeypatch.setattr(url_filter, "MAX_BITS", most_bits)
    universe = spark.range(3000).selectExpr("cast(id as string) as key")
    cascade = url_filter.build_cascade(universe, universe.where("cast(key as int) % 7 = 0"))
    assert cascade.whole == (most_bits == url_filter.MAX_BITS)
    assert sorted(int(r.key) for r in cascade.listed(universe).collect()) == list(range(0, 3000, 7))


def test_preferences(spark):
    t = lambda c, *turns: [(c, k, r, x) for k, (r, x) in enumerate(turns)]
    rows = t(0, ("user", "hi"), ("assistant", "a"), ("user", "b")) + t(1, ("user", "hi"), ("assistant", "cc"), (None, None)) + t(2, ("user", "only")) + t(4, ("user", "s")) + t(5, ("user", "s")) + [(None, 0, "user", "lost")]
    got = {r.pair_id: r for r in preference.format_preferences(preference.conversations_as_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    r = got[0]
    assert (r.n_prefix, r.prompt) == (1, "<|user|>\nhi<|end|>\n") and r.rejected_text == "<|assistant|>\ncc<|end|>\n<|unknown|>\n<|end|>\n"
    (span,) = r.rejected_mask
    assert r.rejected_text[span.start : span.start + span.length] == "cc<|end|>"
    assert got[1].n_prefix == 0 and got[1].rejected_text == "" and got[2].n_prefix == 1 and got[2].chosen_text == ""
    assert len(got) == 3


def test_preferences_odd(spark):
    rows = [(0, 1, "user", "x" * 200000, 1), (0, 1, "user", "x" * 200000, 1), (0, None, None, None, 2), (1, 1, "user", "x" * 200000, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt int")
    (r,) = preference.format_preferences(preference.conversations_as_pairs(df).selectExpr("*", "'p' AS prompt", "7 AS other")).collect()
    assert r.other == 7 and r.n_prefix == 0 and r.chosen_text.count("<|end|>") == 3 and len(r.rejected_text) > 200000
    assert preference.format_preferences(preference.conversations_as_pairs(df.limit(0))).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, component string, n_words int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with internal names."""
    en = "the old man and the sea was a story that he had told to all of the children in that town for many years and more of them came "
    rows = [(1, en, "en", "a", len(en)), (1, en, "en", "a", len(en)), (1, "another story of the same number but not of the same words at all that was", "en", None, None), (2, en.upper(), "en", "b", 9), (None, en, None, None, None), (3, None, "en", "a", 0), (4, "", None, "a", 0), (5, en * 3000, "en", "c", 1), (6, "12 34", "en", "c", 5), (7, "und der alte mann hat nicht die ganze zeit auf dem meer verbracht sondern war auch zu haus", "de", "c", 5)]
    return spark.createDataFrame([(*r, 5, "c", None) for r in rows], DOCS)


def test_stages_on_odd_tables(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, "zeit auf dem meer verbracht sondern war auch zu haus"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0, name
        found = stage(spark, odd_docs, str(tmp_path))
        assert name == "packing" or found.columns == corpus_pipeline.COLUMNS
        kept[name] = found.collect()
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept["language"]) and len(kept["language"]) == 7
    near = [(r.doc_id, (r.text or "")[:9]) for r in kept["near_duplicates"]]
    assert sorted(near, key=repr) == sorted([(1, "the old m"), (1, "another s"), (None, "the old m"), (3, ""), (7, "und der a"), (6, "12 34")], key=repr)
    assert len(kept["repeated_passages"]) == 10 and len([r for r in kept["repeated_passages"] if r.doc_id == 2 and r.text]) == 1
    assert [r.doc_id for r in kept["benchmark_leaks"]].count(7) == 0 and len(kept["benchmark_leaks"]) == 9
    assert {r.doc_id for r in kept["packing"]} == {None, *range(1, 8)}


def test_pipeline_by_brute_force(spark):
    """The first four stages on a whole table, each against a slow version on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r.item_id: re.findall("[0-9a-z\x80-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    grams = {tuple(w[i : i + min(10, len(w))]) for w in items.values() if w for i in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        got = sorted(map(tuple, docs.select("doc_id", "text").collect()))
        if name == "language":
            found = slow_language([(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None], [r.text for r in rows])
            want = [(r.doc_id, r.text) for r, (lang, share) in zip(rows, found, strict=True) if lang != "und" and share >= corpus_pipeline.MIN_SHARE]
        elif name == "near_duplicates":
            first = {min(g) for g in slow_resembling([(r.doc_id, r.text) for r in rows])}
            want = [(r.doc_id, r.text) for r in rows if r.doc_id in first]
        elif name == "repeated_passages":
            digests = {i: sha for i, _, _, _, sha in brute_repeats([(r.doc_id, r.text) for r in rows], 50)}
            assert [i for i, _ in got] == sorted(digests)
            whole = [(i, t) for i, t in got if hashlib.sha256(t.encode()).hexdigest() == digests[i]]
            want = got if len(whole) > 0.98 * len(got) else []  # the rest are cut inside a character
        else:
            spoilt = lambda t: any(tuple(w[i : i + n]) in grams for w in [re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())] for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
            want = [(r.doc_id, r.text) for r in rows if not spoilt(r.text)]
        assert got == sorted(want), name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.select("doc_id").distinct().count() == counts[-1]

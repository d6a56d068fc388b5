"""Hand-checked cases of the library's own operators."""

import math
import random
import tracemalloc
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.postings import decode_gaps, encode_gaps
from tessera.functions.text import tokenize
from tessera.operators import classify, cooccurrence, graph, packed, relational, retrieval, text
from tessera.sources import readers, writers
from tessera.streaming import sinks, windows


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_tokenize(spark):
    got = lines(spark, "Hello, 'tis rock-n-roll!! 42 --").select(tokenize(F.col("line"))).first()[0]
    assert got == ["hello", "tis", "rock-n-roll"]


def test_followers(spark):
    df = lines(spark, "perfect perfect day", "a perfect day")
    assert rows(text.follower_count(df, "perfect", above=0), "word", "n") == [("day", 2), ("perfect", 1)]
    assert rows(text.follower_count(df, "perfect"), "word", "n") == [("day", 2)]


def test_relative_frequency(spark):
    got = {(x, y): v for x, y, v in rows(text.relative_frequency_pairs(lines(spark, "a b a c")), "x", "y", "value")}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "a"): 1.0, ("a", "*"): 2.0, ("b", "*"): 1.0}
    assert dict(rows(text.relative_frequency_stripes(lines(spark, "a b a c")).select("x", F.col("stripe")["b"].alias("b")).where("b is not null"), "x", "b")) == {"a": 0.5}


def test_pmi(spark):
    df = lines(spark, "a b", "a", "")
    (p, q) = cooccurrence.pmi_pairs(df).collect()
    assert p.pmi == pytest.approx(math.log10(1.5)) == q.pmi and {p.x, q.x} == {"a", "b"}
    assert cooccurrence.pmi_pairs(df, mode="multi_token_lines").first().pmi == pytest.approx(math.log10(3))
    many = " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(41))
    assert cooccurrence.pmi_pairs(lines(spark, many)).where("x = 'wbo'").count() == 0
    stripes = {r.x: {k: v.cooc for k, v in r.stripe.items()} for r in cooccurrence.pmi_stripes(lines(spark, "a b a c"), by_occurrence=True).collect()}
    assert stripes["a"]["b"] == 2 and stripes["b"]["a"] == 1


@pytest.mark.parametrize(("mode", "by_occurrence", "threshold"), [("all_lines", False, 1), ("multi_token_lines", False, 4), ("all_lines", True, 4), ("multi_token_lines", True, 1)])
def test_pairs_by_hand(spark, mode, by_occurrence, threshold):
    """Pairs against a loop; what is shuffled are packed blocks, not pairs (of which each had a row of an aggregate before)."""
    rng = random.Random(3)
    texts = [" ".join("w" + chr(97 + int(rng.paretovariate(0.7)) % 26) for _ in range(rng.choice([0, 1, 2, 5, 60]))) for _ in range(150)] + ["rare rare rare rare rare once"]
    cooc, single = {}, {}
    for t in texts:
        seen = t.split()[:40]
        for x in set(seen):
            single[x] = single.get(x, 0) + (mode == "all_lines" or len(set(seen)) > 1)
        for x in seen if by_occurrence else set(seen):
            for y in set(seen) - {x}:
                cooc[x, y] = cooc.get((x, y), 0) + 1
    want = {(x, y): (n, math.log10(n * len(texts) / (single[x] * single[y]))) for (x, y), n in cooc.items() if n >= threshold}
    scored = cooccurrence._scored(lines(spark, *texts).repartition(3), threshold, mode, 40, by_occurrence)
    got = {(r.x, r.y): (r.cooc, r.pmi) for r in scored.collect()}
    assert got.keys() == want.keys() and len(got) == scored.count()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan


def test_no_pairs(spark):
    assert cooccurrence.pmi_pairs(lines(spark, "", "a", "b")).count() == 0 and cooccurrence.pmi_stripes(lines(spark, "").limit(0)).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for high in (50, 1 << 20, 1 << 44):
        codes, a, b = rng.integers(0, high, 5000), rng.integers(1, 4, 5000), rng.integers(1, 1 << 30, 5000)
        want = {}
        for c, x, y in zip(codes.tolist(), a.tolist(), b.tolist(), strict=True):
            want[c] = (want.get(c, (0, 0))[0] + x, want.get(c, (0, 0))[1] + y)
        got = packed.summed(codes, [a, b])
        assert {c: (x, y) for c, x, y in zip(*(g.tolist() for g in got), strict=True)} == want
        back = packed.unpack(pa.py_buffer(packed.pack(*got)))
        assert all((x == y).all() for x, y in zip(got, back, strict=True))


def test_index(spark):
    docs = spark.createDataFrame([(3, "x x"), (7, "x y")], "doc long, text string")
    index = retrieval.build_index(docs)
    assert {r.term: (r.segment, r.df, [tuple(p) for p in r.postings]) for r in index.collect()} == {"x": (0, 2, [(3, 2), (4, 1)]), "y": (0, 1, [(7, 1)])}
    parts = retrieval.build_index(docs, span=4)
    assert rows(parts.where("term = 'x'"), "segment", "df") == [(0, 1), (1, 1)] and rows(retrieval.document_frequencies(parts), "term", "df") == [("x", 2), ("y", 1)]
    assert rows(retrieval.postings_of(parts, ["x"]), "doc", "tf") == [(3, 2), (7, 1)]
    stored = retrieval.stored_index(docs)
    assert rows(stored, "term", "df") == rows(index, "term", "df")
    assert "PushedFilters: [In(term" in retrieval.postings_of(stored, ["x", "z"])._jdf.queryExecution().toString()
    ask = lambda q: [r.doc for r in retrieval.boolean_query(index, q).orderBy("doc").collect()]
    assert ask("x y AND") == [7] and ask("x y OR") == [3, 7] and ask("zzz") == []
    with pytest.raises(ValueError):
        ask("x AND")
    long = spark.createDataFrame([(1, "a" * 81), (2, "b")], "doc long, text string")
    assert [r.snippet for r in retrieval.fetch_lines(long.select("doc"), long).orderBy("doc").collect()] == ["a" * 80 + "...", "b"]


def test_index_by_hand(spark):
    """Null and repeated ids, null texts, ids below zero, in many partitions; postings are packed before they are shuffled, rows of an aggregate before."""
    rng = random.Random(5)
    texts = [(rng.choice([None, -5, -4097, rng.randrange(20000)]), rng.choice([None, "", " ".join(rng.choices("abcdefgh", k=30))])) for _ in range(120)]
    want = {}
    for doc, t in texts:
        for x in (t or "").split():
            want[x, doc] = want.get((x, doc), 0) + 1
    index = retrieval.build_index(spark.createDataFrame(texts, "doc long, text string").repartition(5), partitions=3)
    got = {(r.term, r.doc): r.tf for r in retrieval.postings_of(index, list("abcdefgh")).collect()}
    assert got == want and {r.term: r.df for r in retrieval.document_frequencies(index).collect()} == {x: sum(k[0] == x for k in want) for x in "abcdefgh"}
    assert all(r.segment is None or all(g.gap > 0 for g in r.postings[1:]) for r in index.collect())
    known = retrieval.build_index(spark.createDataFrame([(1, "a")], "doc long, text string").where("doc is not null"))
    assert "MapInArrow" in known._jdf.queryExecution().executedPlan().toString()


def test_gaps_round_trip(spark):
    df = spark.sql("SELECT 1 AS k, array(named_struct('doc', 5L, 'tf', 1L), named_struct('doc', 9L, 'tf', 2L), named_struct('doc', 10L, 'tf', 3L)) AS p")
    assert rows(decode_gaps(df.select("k", encode_gaps(F.col("p")).alias("postings")), ["k"]), "doc", "tf") == [(5, 1), (9, 2), (10, 3)]


GRAPH = [(0, [1, 2]), (1, [2]), (2, []), (3, [0])]


def nodes(spark, adj=GRAPH):
    return spark.createDataFrame(adj, "id long, adj array<long>")


@pytest.mark.parametrize("sources", [(0, 1), (0, 2, 2)])
def test_personalized_mass(spark, sources):
    for k in (1, 4):
        assert graph.personalized_pagerank(nodes(spark), sources, k).agg(F.sum("p")).first()[0] == pytest.approx(1.0)


def test_pagerank_follows_the_recurrence(spark):
    p = {i: 0.25 for i, _ in GRAPH}
    for _ in range(4):
        mass = dict.fromkeys(p, 0.0)
        for i, adj in GRAPH:
            for j in adj:
                mass[j] += p[i] / len(adj)
        lost = 1 - sum(mass.values())
        p = {i: 0.15 / 4 + 0.85 * (mass[i] + lost / 4) for i in p}
    assert {r.id: r.p for r in graph.pagerank(nodes(spark), 4).collect()} == pytest.approx(p)


def test_ranks_lie_with_their_structure(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        structure = graph.dealt(nodes(spark))
        ranks = graph.cut_by(graph.build_ranked_nodes(structure, None).select("id", "p"), "id", 8)
        plan = ranks.join(graph._messages(structure, ranks), "id", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    with pytest.raises(ValueError, match="2 records"):
        graph.dealt(nodes(spark, [(1, [2]), (1, [])]))


def test_pagerank_to_convergence(spark):
    ranked = graph.pagerank(nodes(spark), 200, tolerance=1e-6)
    again = graph.pagerank(nodes(spark), 30)
    assert {r.id: r.p for r in ranked.collect()} == pytest.approx({r.id: r.p for r in again.collect()}, abs=1e-4)
    order = [(r.p, -r.id) for r in graph.ranked_order(ranked).collect()]
    assert order == sorted(order, reverse=True)
    assert tuple(graph.message_counters(graph.build_ranked_nodes(nodes(spark), None)).first()) == (3, 4, 1)


def test_a_round_sends_messages_once(spark, monkeypatch):
    """Two rounds, two message plans: what arrives tells what is missing. Each round built them twice before."""
    made, send = [], graph._messages
    monkeypatch.setattr(graph, "_messages", lambda *a: made.append(1) or send(*a))
    ranked = graph.pagerank(nodes(spark), 2)
    assert len(made) == 2 and ranked.agg(F.sum("p")).first()[0] == pytest.approx(1.0)
    assert graph.pagerank(nodes(spark).limit(0), 2).count() == 0


def test_unknown_edge_loses_mass(spark):
    got = graph.personalized_pagerank(nodes(spark, [(0, [1, 9]), (1, [0])]), [0], 1)
    assert {r.id: r.p for r in got.collect()} == pytest.approx({0: 0.15, 1: 0.425})
    assert graph.graph_counters(nodes(spark, [(0, [1, 9]), (1, [0])])).first().n_missing == 1


def test_components_and_partitions(spark):
    path = [(i, [i + 1] if i % 10 < 9 else []) for i in range(50)]
    assert {r.id: r.component for r in graph.weak_components(nodes(spark, path)).collect()} == {i: i // 10 * 10 for i in range(50)}
    dealt = graph.partition_nodes(nodes(spark, path), 5, by_range=True, node_count=50)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.where("part <> id div 10").count() == 0
    assert graph.dump_nodes(graph.build_ranked_nodes(nodes(spark), [0])).where("id = 0").first().record == "{0 1.0000 [1, 2]}"


def _labels_by_hand(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(parent)}


def test_component_labels_whatever_the_shape(spark):
    falling = [0, *range(300, 0, -1)]  # the least label is far from the other local minimum
    dice = random.Random(4)
    shapes = {
        "falling path": list(pairwise(falling)),
        "rising path": list(pairwise(range(200))),
        "star around the largest": [(1000, k) for k in range(50)],
        "comb": [(k, k + 1) for k in range(0, 60, 2)] + [(k + 1, k + 2) for k in range(0, 60, 2)],
        "sparse": [(dice.randrange(300), dice.randrange(300)) for _ in range(200)],
        "loops and copies": [(5, 5), (7, 6), (6, 7), (7, 6), (-3, 5)],
    }
    for name, edges in shapes.items():
        got = graph.component_labels(spark.createDataFrame(edges, "a bigint, b bigint"))
        assert sorted(map(tuple, got.collect())) == sorted(_labels_by_hand(edges).items()), name
    assert graph.component_labels(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    alone = graph.component_labels(spark.createDataFrame([(2, 1)], "a bigint, b bigint"), spark.createDataFrame([(1,), (2,), (9,), (None,)], "id bigint"))
    assert sorted(map(tuple, alone.collect())) == [(1, 1), (2, 1), (9, 9)]


def test_sgd(spark):
    df = spark.createDataFrame([("d1", "spam", [1, 2], 1), ("d2", "ham", [1], 2)], "docid string, label string, features array<int>, position int")
    w = {r.feature: r.weight for r in classify.train(df).collect()}
    p = 1 / (1 + math.exp(-0.001))
    assert w == pytest.approx({1: 0.001 - 0.002 * p, 2: 0.001})


def test_sgd_equals_a_loop(spark):
    rng = random.Random(7)
    data = [(f"d{i}", rng.choice(["spam", "ham"]), [rng.randint(0, 20) for _ in range(5)], rng.random()) for i in range(200)]
    w = {}
    for _, label, fs, _ in sorted(data, key=lambda r: r[3]):
        g = ((label == "spam") - 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in fs)))) * 0.002
        for f in fs:
            w[f] = w.get(f, 0.0) + g
    df = spark.createDataFrame(data, "docid string, label string, features array<int>, position double")
    assert {r.feature: r.weight for r in classify.train(df).collect()} == pytest.approx(w)


def test_weights_are_held_in_few_bytes():
    """Blocks of new, known and repeated features against a loop; 300,000 weights take under 10 MB (a dict of floats takes over 30)."""
    rng, w = random.Random(9), {}
    known, weights = np.empty(0, np.int32), np.empty(0)
    for _ in range(5):
        data = [(rng.choice(["spam", "ham"]), [rng.randint(0, 40) for _ in range(rng.randint(0, 6))]) for _ in range(30)]
        for label, fs in data:
            g = ((label == "spam") - 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in fs)))) * 0.5
            for f in fs:
                w[f] = w.get(f, 0.0) + g
        known, weights = classify._stepped(known, weights, pa.array([d[0] for d in data]), pa.array([d[1] for d in data], pa.list_(pa.int32())), 0.5)
    assert dict(zip(known.tolist(), weights.tolist(), strict=True)) == pytest.approx(w)
    tracemalloc.start()
    many = classify._stepped(known, weights, pa.array(["spam"]), pa.array([list(range(300000))], pa.list_(pa.int32())), 0.5)
    assert tracemalloc.get_traced_memory()[0] < 20e6 and sum(a.nbytes for a in many) < 10e6
    tracemalloc.stop()


def test_vote_tie_is_ham(spark):
    docs = spark.createDataFrame([("d", [1, 1, 5])], "docid string, features array<int>")
    models = spark.createDataFrame([("a", 1, 0.5), ("b", 1, -0.5)], "model_id string, feature int, weight double")
    assert tuple(classify.apply_ensemble(docs, models, "vote").first()) == ("d", 0.0, "ham")
    assert classify.score(docs, models).where("model_id = 'a'").first().score == 1.0


def test_vote_of_weights_that_cancel_out(spark):
    """0.1 + 0.2 - 0.3 is over zero in doubles, in one order of adding, and 0.3 - 0.2 - 0.1 under it in another."""
    docs = spark.createDataFrame([("d", [1, 2, 3])], "docid string, features array<int>")
    models = spark.createDataFrame([(m, k + 1, s * w) for m, s in (("a", 1), ("b", -1)) for k, w in enumerate((0.1, 0.2, -0.3))], "model_id string, feature int, weight double").coalesce(1)
    assert tuple(classify.apply_ensemble(docs, models, "vote", digits=6).first()) == ("d", -2.0, "ham")


def test_regions(spark):
    x0, x1, y0, y1 = geo.REGIONS["goldman"]
    df = spark.createDataFrame([(x0, y1), (x1, y0), (x1 + 1e-6, y0)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.region_label(F.col("lon"), F.col("lat"))).collect()] == ["goldman", "goldman", None]
    assert geo.bounding_box([(1, 5), (0, 9)]) == (0, 1, 5, 9)
    trip = spark.createDataFrame([("green" + "," * 8 + "1.5,2.5",), ("yellow" + "," * 10 + "3.5,4.5",)], "value string")
    assert rows(readers.parse_trips(trip), "taxi", "lon", "lat") == [("green", 1.5, 2.5), ("yellow", 3.5, 4.5)]


def events(spark, counts, minutes):
    at = [(f"2024-01-01 00:00:00", k, i, "a") for k, n in enumerate(counts) for i in range(n)]
    df = spark.createDataFrame(at, "base string, w int, i int, key string")
    return df.selectExpr(f"cast(base as timestamp) + make_interval(0,0,0,0,0,w * {minutes}, i) AS ts", "key")


@pytest.mark.parametrize(("counts", "alerts"), [((12, 0, 12), [(12, 0), (12, 0)]), ((12, 20, 40), [(12, 0), (40, 20)])])
def test_trends_in_batch_and_stream(spark, tmp_path, counts, alerts):
    df = events(spark, counts, 10)
    assert sorted((r.n, r.prev) for r in windows.trends(df).collect()) == sorted(alerts)
    windows.windowed_counts(df, "10 minutes").orderBy("window_end").coalesce(1).write.parquet(f"{tmp_path}/counts")
    stream = spark.readStream.schema("window_end timestamp, key string, n long").parquet(f"{tmp_path}/counts")
    with windows.keyed_state(spark):
        got = windows.trend_alerts(sinks.drain(windows.stream_trends(stream, 600), "trends"), 10)
    assert sorted((r.n, r.prev) for r in got.collect()) == sorted(alerts)


def test_hourly_stream_equals_batch(spark, tmp_path):
    df = events(spark, (5, 0, 3), 60)
    assert [r.n for r in windows.hourly_counts(df).orderBy("window_end").collect()] == [5, 0, 3]
    df.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    got = sinks.drain_updates(windows.windowed_counts(stream, "60 minutes"), "hours", ["window_end", "key"])
    assert [r.n for r in got.orderBy("window_end").collect()] == [5, 3]


def test_text_stream_in_several_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"part-{k}").write_text(f"green,,,,,,,,{k}.5,1\nyellow,,,,,,,,0,0,2.5,1\n")
    (tmp_path / "in" / "other").write_text("not read")
    trips = readers.parse_trips(readers.stream_text(spark, f"{tmp_path}/in"))
    sinks.each_batch(trips, f"{tmp_path}/out", lambda batch, path: batch.select("taxi", "lon", "file").write.mode("overwrite").parquet(path))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["part-00000000", "part-00000001", "part-00000002"]
    found = spark.read.parquet(*[sinks.batch_path(f"{tmp_path}/out", k) for k in range(3)])
    assert rows(found, "taxi", "lon", "file") == sorted([("green", k + 0.5, f"part-{k}") for k in range(3)] + [("yellow", 2.5, f"part-{k}") for k in range(3)])
    counts = trips.groupBy("taxi").agg(F.count("*").alias("n"))
    assert rows(sinks.drain_updates(counts, "taxis", ["taxi"]), "taxi", "n") == [("green", 3), ("yellow", 3)]


def test_text_tables_equal_parquet(spark, tmp_path):
    for table in ("orders", "lineitem"):
        df = readers.load(spark, "/root/testdata/sf0.001", table)
        width = {"orders": 9, "lineitem": 16}[table]
        cells = [F.col(c).cast("date").cast("string") if t == "timestamp_ntz" else F.col(c).cast("string") for c, t in df.dtypes]
        if table == "orders":
            cells = [*cells, F.lit("clerk"), F.lit("0")]
        df.select(F.concat_ws("|", *cells, *[F.lit("")] * (width - len(cells))).alias("v")).coalesce(1).write.text(f"{tmp_path}/{table}.tbl")
    both = [[readers.load(spark, d, t, f) for t in ("lineitem", "orders")] for d, f in (("/root/testdata/sf0.001", "parquet"), (str(tmp_path), "text"))]
    a, b = (relational.shipped_clerks(*t, "1998-08-23").collect() for t in both)
    assert a == b and a
    plan = relational.shipped_count(both[0][0], "1998-08-23")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan and "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan


def test_readers_and_writers(spark, tmp_path):
    raw = spark.createDataFrame([("1 2  3",), ("4",), ("",)], "value string")
    assert [(r.id, r.adj) for r in readers.parse_adjacency(raw).orderBy("id").collect()] == [(1, [2, 3]), (4, [])]
    doc = spark.createDataFrame([("d1 spam 1 2",), ("d2 ham",)], "value string")
    assert [tuple(r) for r in readers.parse_labelled(doc).collect()] == [("d1", "spam", [1, 2]), ("d2", "ham", [])]
    model = spark.createDataFrame([(1, 0.5), (2, -1.0)], "feature int, weight double").coalesce(1)
    writers.write_tuples(model, f"{tmp_path}/model")
    assert rows(readers.read_models(spark, f"{tmp_path}/model"), "feature", "weight") == [(1, 0.5), (2, -1.0)]
    writers.write_keyed(model, f"{tmp_path}/keyed", "feature", 2)
    assert spark.read.parquet(f"{tmp_path}/keyed").count() == 2
    writers.write_tsv(model, f"{tmp_path}/tsv")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/tsv").collect()) == ["1\t0.5", "2\t-1.0"]
    writers.write_nodes(graph.build_ranked_nodes(nodes(spark), [0]), f"{tmp_path}/nodes")
    assert spark.read.text(f"{tmp_path}/nodes").count() == 4
    spark.createDataFrame([("a\nb",)], "value string").coalesce(1).write.text(f"{tmp_path}/lines")
    assert [r.line for r in readers.read_lines(spark, f"{tmp_path}/lines").orderBy("line_no").collect()] == ["a", "b"]
    many = [f"line {k} " + "x" * (k % 97) for k in range(5000)]
    (tmp_path / "split").mkdir()
    (tmp_path / "split" / "one.txt").write_text("\n".join(many) + "\n")
    (tmp_path / "split" / "two.txt").write_text("\n".join(many[:100]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.read_lines(spark, f"{tmp_path}/split")
        assert got.rdd.getNumPartitions() > 8
        found = got.orderBy("file", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in found] == many + many[:100] and [r.line_no for r in found] == [*range(5000), *range(100)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 152
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""name -> query and name -> oracle SQL, for the library's own operators (the llm subpackage registers its own)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify, cooccurrence, graph, relational, retrieval, text
from tessera.operators.checkpoints import checkpoint_dir, cut
from tessera.sources.readers import document_lines, load
from tessera.streaming import sinks, windows

DAY, CUTOFF = "1998-08-23", "1998-06-15"
TRIGGER, MIN_LINES, TREND = "the", 10, 3
SOURCES, ROUNDS = (0, 1, 2), 5
#: How late an event may come; the files of a table may be listed in any order.
LATE = "3650 days"
RPN = ["the and AND", "tion the OR", "of der AND que OR", "zzzunknown"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [load(spark, d, n) for n in names]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(load(spark, d, "documents"))


# ---- relational

@query(f"SELECT count(*) AS n_items FROM lineitem WHERE l_shipdate::date = DATE '{DAY}'")
def q1_shipped_count(spark, d):
    return relational.shipped_count(load(spark, d, "lineitem"), DAY)


@query(f"SELECT o_orderpriority, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::date = DATE '{DAY}' ORDER BY o_orderkey, o_orderpriority LIMIT 20")
def q2_shipped_clerks(spark, d):
    return relational.shipped_clerks(*_t(spark, d, "lineitem", "orders"), DAY)


@query(f"SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate::date = DATE '{DAY}' ORDER BY ALL LIMIT 20")
def q3_shipped_parts(spark, d):
    return relational.shipped_parts(*_t(spark, d, "lineitem", "part", "supplier"), DAY)


_NATIONS = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT n_nationkey, n_name, count(*) AS n_items {_NATIONS} WHERE l_shipdate::date = DATE '{DAY}' GROUP BY ALL")
def q4_shipped_by_nation(spark, d):
    return relational.shipped_by_nation(*_t(spark, d, "lineitem", "orders", "customer", "nation"), DAY)


@query(f"SELECT n_nationkey, n_name, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_items {_NATIONS} WHERE n_nationkey IN (3, 24) GROUP BY ALL")
def q5_monthly_shipments(spark, d):
    return relational.monthly_by_nation(*_t(spark, d, "lineitem", "orders", "customer", "nation"))


@query(f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate::date = DATE '{DAY}' GROUP BY ALL""")
def q6_pricing_summary(spark, d):
    return relational.pricing_summary(load(spark, d, "lineitem"), DAY)


@query(f"""SELECT c_name, l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey WHERE l_shipdate::date > DATE '{CUTOFF}' AND o_orderdate::date < DATE '{CUTOFF}' GROUP BY ALL ORDER BY revenue DESC, l_orderkey, c_name LIMIT 5""")
def q7_unshipped_orders(spark, d):
    return relational.unshipped_orders(*_t(spark, d, "lineitem", "orders", "customer"), CUTOFF)


# ---- text

def _tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({x}), '[ \\t\\n\\r\\f]+'), lambda w: regexp_replace(w, '(^[^a-z]+|[^a-z]+$)', '', 'g')), lambda w: length(w) > 0)"


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
_TOK = f"{_LINES}, tok AS (SELECT doc_id, {_tokens('line')} AS t FROM lines)"
_BI = f"{_TOK}, idx AS (SELECT t, unnest(range(1, len(t))) AS i FROM tok WHERE len(t) > 1), bi AS (SELECT t[i] AS x, t[i + 1] AS y FROM idx), bc AS (SELECT x, y, count(*) AS n FROM bi GROUP BY ALL)"


@query(f"WITH {_TOK} SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM tok) GROUP BY ALL")
def word_count(spark, d):
    return text.word_count(_lines(spark, d))


@query(f"WITH {_BI} SELECT y AS word, n FROM bc WHERE x = '{TRIGGER}' AND n > 1")
def follower_count(spark, d):
    return text.follower_count(_lines(spark, d), TRIGGER)


@query(f"WITH {_BI} SELECT * FROM bc")
def bigram_count(spark, d):
    return text.bigram_count(_lines(spark, d))


@query(f"WITH {_BI} SELECT x, y, round(n / sum(n) OVER (PARTITION BY x), 9) AS value FROM bc UNION ALL SELECT x, '*', sum(n)::DOUBLE FROM bc GROUP BY x")
def bigram_frequency_pairs(spark, d):
    return text.relative_frequency_pairs(_lines(spark, d)).withColumn("value", F.round("value", 9))


def _stripe_text():
    """Entries as ``y=f``, f in millionths, since the engines print halves differently."""
    return F.array_join(F.transform(F.map_entries("stripe"), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1000000).cast("string"))), ";")


@query(f"WITH {_BI}, f AS (SELECT x, y, n / sum(n) OVER (PARTITION BY x) AS value FROM bc) SELECT x, string_agg(y || '=' || floor(value * 1000000)::BIGINT, ';' ORDER BY y) AS stripe FROM f GROUP BY x")
def bigram_frequency_stripes(spark, d):
    return text.relative_frequency_stripes(_lines(spark, d)).select("x", _stripe_text().alias("stripe"))


# ---- co-occurrence

def _pmi(mode: str, occurrence: bool = False) -> str:
    keep = "WHERE len(u) > 1" if mode == "multi_token_lines" else ""
    return f"""WITH {_TOK}, f AS (SELECT t[1:40] AS t, list_distinct(t[1:40]) AS u FROM tok), n AS (SELECT count(*)::DOUBLE AS n FROM lines),
 c AS (SELECT w, count(*) AS c FROM (SELECT unnest(u) AS w FROM f {keep}) GROUP BY ALL), x AS (SELECT unnest({'t' if occurrence else 'u'}) AS x, u FROM f WHERE len(u) > 1),
 xy AS (SELECT x, y, count(*) AS cooc FROM (SELECT x, unnest(u) AS y FROM x) WHERE x <> y GROUP BY ALL HAVING count(*) >= {MIN_LINES}),
 p AS (SELECT x, y, log10(cooc::DOUBLE * n.n / (a.c::DOUBLE * b.c)) AS pmi, cooc FROM xy JOIN c a ON x = a.w JOIN c b ON y = b.w, n) """


@query(_pmi("all_lines") + "SELECT x, y, round(pmi, 9) AS pmi, cooc FROM p")
def pmi_pairs_all_lines(spark, d):
    return cooccurrence.pmi_pairs(_lines(spark, d), MIN_LINES).withColumn("pmi", F.round("pmi", 9))


@query(_pmi("all_lines") + "SELECT x, y, round(pmi, 9) AS pmi, cooc FROM p ORDER BY x, y")
def pmi_pairs_sorted(spark, d):
    return cooccurrence.sorted_pairs(cooccurrence.pmi_pairs(_lines(spark, d), MIN_LINES).withColumn("pmi", F.round("pmi", 9)))


@query(_pmi("multi_token_lines") + "SELECT x, y, round(pmi, 9) AS pmi, cooc FROM p")
def pmi_pairs_multi_token_lines(spark, d):
    return cooccurrence.pmi_pairs(_lines(spark, d), MIN_LINES, "multi_token_lines").withColumn("pmi", F.round("pmi", 9))


_STRIPE = "SELECT x, string_agg(y || '=' || cooc, ';' ORDER BY y) AS stripe, round(sum(pmi), 5) AS pmi_sum FROM p GROUP BY x"


def _pmi_stripe(df: DataFrame) -> DataFrame:
    entries = F.map_entries("stripe")
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]["cooc"].cast("string"))), ";")
    total = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["value"]["pmi"])
    return df.select("x", shown.alias("stripe"), F.round(total, 5).alias("pmi_sum"))


@query(_pmi("multi_token_lines") + _STRIPE)
def pmi_stripes(spark, d):
    return _pmi_stripe(cooccurrence.pmi_stripes(_lines(spark, d), MIN_LINES, "multi_token_lines"))


@query(_pmi("all_lines", occurrence=True) + _STRIPE)
def pmi_stripes_by_occurrence(spark, d):
    return _pmi_stripe(cooccurrence.pmi_stripes(_lines(spark, d), MIN_LINES, by_occurrence=True))


# ---- retrieval

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


_TF = f"tf AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL)"


@query(f"""WITH {_TF}, g AS (SELECT term, doc // {retrieval.SPAN} AS segment, doc, tf, doc - coalesce(lag(doc) OVER (PARTITION BY term, doc // {retrieval.SPAN} ORDER BY doc), 0) AS gap FROM tf),
 n AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, segment, df, string_agg(gap || ':' || tf, ' ' ORDER BY doc) AS postings FROM g JOIN n USING (term) GROUP BY ALL""")
def inverted_index(spark, d):
    index = retrieval.stored_index(_docs(spark, d))
    shown = F.array_join(F.transform("postings", lambda p: F.concat(p["gap"].cast("string"), F.lit(":"), p["tf"].cast("string"))), " ")
    return index.select("term", "segment", shown.alias("postings")).join(retrieval.document_frequencies(index), "term").select("term", "segment", "df", "postings")


def _rpn_sql(rpn: str) -> str:
    stack: list[str] = []
    for token in rpn.split():
        if token in ("AND", "OR"):
            b, a = stack.pop(), stack.pop()
            stack.append(f"(({a}) {'INTERSECT' if token == 'AND' else 'UNION'} ({b}))")
        else:
            stack.append(f"SELECT doc FROM tf WHERE term = '{token}'")
    return f"SELECT '{rpn}' AS query, doc FROM ({stack[-1]})"


@query(f"WITH {_TF} " + " UNION ALL ".join(map(_rpn_sql, RPN)))
def boolean_retrieval(spark, d):
    return retrieval.boolean_queries(retrieval.stored_index(_docs(spark, d)), RPN)


@query(f"WITH {_TF} SELECT doc, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS snippet FROM ({_rpn_sql(RPN[0])}) JOIN documents ON doc = doc_id")
def boolean_retrieval_lines(spark, d):
    docs = _docs(spark, d)
    return retrieval.fetch_lines(retrieval.boolean_query(retrieval.stored_index(docs), RPN[0]), docs)


# ---- graph

_GRAPH = """e0 AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'),
 e AS (SELECT DISTINCT src, dst FROM e0 WHERE dst IS NOT NULL AND src <> dst), v AS (SELECT p_partkey AS id, (SELECT count(*) FROM e WHERE src = p_partkey) AS deg FROM part)"""


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.part_sequence_graph(*_t(spark, d, "lineitem", "part"))


def _rank_sql(personal: bool, rounds: int = ROUNDS) -> str:
    s = ", ".join(map(str, SOURCES))
    n = str(len(SOURCES)) if personal else "(SELECT count(*) FROM v)"
    at = f"CASE WHEN id IN ({s}) THEN 1.0::DOUBLE ELSE 0 END" if personal else "1.0::DOUBLE"
    ctes = [f"r0 AS (SELECT id, deg, ({at}) / {n} AS p FROM v)"]
    for k in range(1, rounds + 1):
        m = f"m{k} AS MATERIALIZED (SELECT dst AS id, sum(p / deg) AS mass FROM e JOIN r{k - 1} ON src = id GROUP BY dst)"
        lost = f"(SELECT coalesce(sum(p), 0) FROM r{k - 1} WHERE deg = 0)" if personal else f"greatest(0, 1 - (SELECT sum(mass) FROM m{k} WHERE id IN (SELECT id FROM v)))"
        new = f"0.85 * coalesce(mass, 0) + ({at}) * (0.15 + 0.85 * {lost}) / {n}"
        ctes += [m, f"r{k} AS MATERIALIZED (SELECT r.id, deg, {new.replace('WHEN id', 'WHEN r.id')} AS p FROM r{k - 1} r LEFT JOIN m{k} m ON r.id = m.id)"]
    return f"WITH {_GRAPH}, " + ", ".join(ctes)


@query(f"WITH {_GRAPH} SELECT count(*) AS n_nodes, sum(deg)::BIGINT AS n_edges, count(*) FILTER (deg = 0) AS n_dangling, 0::BIGINT AS n_missing FROM v")
def graph_counters(spark, d):
    return graph.graph_counters(_graph(spark, d))


@query(_rank_sql(True) + f" SELECT id, round(p, 10) AS p FROM r{ROUNDS}")
def personalized_pagerank(spark, d):
    return graph.personalized_pagerank(_graph(spark, d), SOURCES, ROUNDS).select("id", F.round("p", 10).alias("p"))


@query(_rank_sql(False) + f" SELECT id, round(p, 10) AS p FROM r{ROUNDS}")
def global_pagerank(spark, d):
    return graph.pagerank(_graph(spark, d), ROUNDS).select("id", F.round("p", 10).alias("p"))


@query(_rank_sql(True) + f" SELECT id, round(p, 5) AS p FROM (SELECT id, round(p, 10) AS p FROM r{ROUNDS}) ORDER BY r10 DESC, id LIMIT 20".replace("round(p, 10) AS p FROM", "p, round(p, 10) AS r10 FROM"))
def top_pagerank(spark, d):
    ranked = graph.personalized_pagerank(_graph(spark, d), SOURCES, ROUNDS).withColumn("exact", F.col("p")).withColumn("p", F.round("p", 10))
    return graph.top_nodes(ranked, 20).select("id", F.round("p", 5).alias("p"))


@query(_rank_sql(False, 60) + " SELECT id, round(p, 7) AS p, round(ln(p), 3) AS log_p FROM r60")
def converged_pagerank(spark, d):
    ranked = graph.ranked_order(graph.pagerank(_graph(spark, d), 200, tolerance=1e-9))
    return ranked.select("id", F.round("p", 7).alias("p"), F.round("log_p", 3).alias("log_p"))


@query(_rank_sql(True, 2) + " SELECT count(*) AS n_active, sum(deg)::BIGINT AS n_messages, (sum(deg) - (SELECT count(DISTINCT dst) FROM e JOIN r2 ON src = id WHERE p > 0))::BIGINT AS n_saved FROM r2 WHERE deg > 0 AND p > 0")
def message_counters(spark, d):
    return graph.message_counters(graph.personalized_pagerank(_graph(spark, d), SOURCES, 2))


@query(f"""WITH RECURSIVE {_GRAPH}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
 walk(id, root) AS (SELECT id, id FROM v UNION SELECT b.b, walk.root FROM walk JOIN b ON walk.id = b.a WHERE walk.root < b.b) SELECT id, min(root) AS component FROM walk GROUP BY id""")
def weak_components(spark, d):
    return graph.weak_components(_graph(spark, d))


@query(f"WITH {_GRAPH}, s AS (SELECT src, list(dst ORDER BY dst)[1:10] AS adj FROM e GROUP BY src) SELECT id, printf('{{%d %.4f [%s]}}', id, CASE WHEN id IN {SOURCES} THEN {1 / len(SOURCES)!r} ELSE 0.0 END, coalesce(array_to_string(adj, ', '), '')) AS record FROM v LEFT JOIN s ON id = src")
def node_dump(spark, d):
    return graph.dump_nodes(graph.build_ranked_nodes(_graph(spark, d), SOURCES))


@query("SELECT p_partkey AS id, (floor(p_partkey / (SELECT count(*) FROM part)::DOUBLE * 8)::BIGINT % 8)::INTEGER AS part FROM part")
def range_partition(spark, d):
    nodes = _graph(spark, d)
    return graph.partition_nodes(nodes, 8, by_range=True, node_count=load(spark, d, "part").count()).select("id", "part")


# ---- classification

MODEL_SEEDS = (1, 2, 3)
_HASH = "('0x' || substr(md5(w), 1, 7))::BIGINT"


def _fixed_model(features: DataFrame, seed: int) -> DataFrame:
    """A model whose weights follow from the feature ids, so that scoring can be checked in SQL."""
    weight = (F.pmod(F.col("feature").cast("bigint") * seed, F.lit(2001)) - 1000) / 1000.0
    return features.select("feature").distinct().where(F.pmod(F.col("feature"), F.lit(3)) > 0).select("feature", weight.alias("weight"), F.lit(f"m{seed}").alias("model_id"))


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(docid, feature) written to shared storage, as models and scores both read them, and all (docid)."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("docid"), "text")
    return cut(classify.feature_rows(docs)), docs.select("docid")


def _scores_sql(seeds) -> str:
    return f"""WITH f AS (SELECT doc_id AS docid, unnest(list_transform(list_distinct({_tokens("text")}), lambda w: {_HASH})) AS feature FROM documents),
 m AS (SELECT s, 'm' || s AS model_id FROM (VALUES {', '.join(f'({s})' for s in seeds)}) q(s)),
 s AS (SELECT doc_id AS docid, m.model_id, coalesce((SELECT sum((((feature * m.s) % 2001) - 1000) / 1000.0::DOUBLE) FROM f WHERE f.docid = doc_id AND feature % 3 > 0), 0) AS score FROM documents, m)"""


@query(_scores_sql([1]) + " SELECT docid, round(score, 6) AS score, CASE WHEN round(score, 6) > 0 THEN 'spam' ELSE 'ham' END AS predicted FROM s")
def apply_classifier(spark, d):
    features, ids = _features(spark, d)
    scored = classify.apply_model(features, _fixed_model(features, 1), ids).withColumn("score", F.round("score", 6))
    return scored.withColumn("predicted", F.when(F.col("score") > 0, "spam").otherwise("ham"))


def _ensemble(spark: SparkSession, d: str, method: str) -> DataFrame:
    features, ids = _features(spark, d)
    models = reduce(DataFrame.unionByName, [_fixed_model(features, s) for s in MODEL_SEEDS])
    return classify.apply_ensemble(features, models, method, ids, digits=6)


@query(_scores_sql(MODEL_SEEDS) + " SELECT docid, round(avg(score), 6) AS score FROM s GROUP BY docid")
def ensemble_average(spark, d):
    return _ensemble(spark, d, "average").select("docid", F.round("score", 6).alias("score"))


@query(_scores_sql(MODEL_SEEDS) + ", v AS (SELECT docid, sum(CASE WHEN round(score, 6) > 0 THEN 1.0::DOUBLE ELSE -1 END) AS score FROM s GROUP BY docid) SELECT docid, score, CASE WHEN score > 0 THEN 'spam' ELSE 'ham' END AS predicted FROM v")
def ensemble_vote(spark, d):
    return _ensemble(spark, d, "vote")


def _training(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels").select(F.col("doc_id").alias("docid"), F.when(F.col("toxic") == 1, "spam").otherwise("ham").alias("label"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("docid"), "text")
    return labels.join(classify.hashed_features(docs.join(labels, "docid", "left_semi")), "docid")


def _train_sql(order: str) -> str:
    """Each document's step follows from the steps before it and from how many features it shares with each."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END AS y, row_number() OVER (ORDER BY {order}) AS i FROM labels JOIN documents USING (doc_id)),
 f AS (SELECT i, unnest(list_transform(list_distinct({_tokens("text")}), lambda w: {_HASH})) AS feature FROM d), m AS (SELECT i, feature, count(*) AS m FROM f GROUP BY ALL),
 o AS (SELECT a.i, b.i AS j, sum(a.m * b.m) AS n FROM m a JOIN m b ON a.feature = b.feature AND b.i < a.i GROUP BY ALL),
 w AS MATERIALIZED (SELECT a.i, list(coalesce(n, 0)::DOUBLE ORDER BY b.i) AS n FROM d a JOIN d b ON b.i < a.i LEFT JOIN o ON o.i = a.i AND o.j = b.i GROUP BY a.i),
 s AS (SELECT 0::BIGINT AS i, []::DOUBLE[] AS steps UNION ALL SELECT d.i, list_append(steps, (y - 1 / (1 + exp(-coalesce(list_dot_product(steps, n), 0)))) * {classify.DELTA}) FROM s JOIN d ON d.i = s.i + 1 LEFT JOIN w ON w.i = d.i)
 SELECT feature::INTEGER AS feature, round(sum(m * steps[m.i]), 8) + 0.0 AS weight FROM m, (SELECT steps FROM s ORDER BY i DESC LIMIT 1) GROUP BY feature"""


@query(_train_sql("doc_id"))
def train_classifier(spark, d):
    return classify.train(_training(spark, d).withColumn("position", F.col("docid"))).withColumn("weight", F.round("weight", 8) + F.lit(0.0))


@query(_train_sql("md5('7:' || doc_id)"))
def train_classifier_shuffled(spark, d):
    return classify.train(classify.shuffled(_training(spark, d), seed=7)).withColumn("weight", F.round("weight", 8) + F.lit(0.0))


# ---- streams and their twins

def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("ts", F.col("event_type").alias("key"), "user_id", "value")


def _event_stream(spark: SparkSession, d: str, files: int = 4) -> DataFrame:
    """The events in the order of time from several files, one a micro-batch, as a stream."""
    events = load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "user_id", "value")
    path = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    events.repartitionByRange(files, "ts").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _counts_sql(minutes: int, source: str = "SELECT ts, event_type AS key FROM events") -> str:
    width = f"INTERVAL {minutes} MINUTES"
    return f"""WITH ev AS ({source}), c AS (SELECT time_bucket({width}, ts) + {width} AS window_end, key, count(*) AS n FROM ev GROUP BY ALL),
 spine AS (SELECT key, unnest(generate_series(min(window_end), (SELECT max(window_end) FROM c), {width})) AS window_end FROM c GROUP BY key),
 z AS (SELECT spine.window_end, spine.key, coalesce(n, 0)::BIGINT AS n FROM spine LEFT JOIN c USING (key, window_end))"""


@query(_counts_sql(60) + " SELECT * FROM z")
def hourly_counts(spark, d):
    return windows.hourly_counts(_events(spark, d))


BOXES = {"west": (0.0, 250.0, 0.0, 20.0), "east": (250.5, 1000.0, 10.0, 60.0)}
_BOXED = "SELECT ts, CASE WHEN user_id BETWEEN 0 AND 250 AND value BETWEEN 0 AND 20 THEN 'west' ELSE 'east' END AS key FROM events WHERE (user_id BETWEEN 0 AND 250 AND value BETWEEN 0 AND 20) OR (user_id BETWEEN 250.5 AND 1000 AND value BETWEEN 10 AND 60)"


@query(_counts_sql(60, _BOXED) + " SELECT * FROM z")
def region_counts(spark, d):
    return windows.hourly_counts(windows.region_events(_events(spark, d), BOXES, "user_id", "value"))


@query(_counts_sql(10) + f", p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY key ORDER BY window_end), 0)::BIGINT AS prev FROM z) SELECT * FROM p WHERE n >= {TREND} AND n >= 2 * prev")
def trend_alerts(spark, d):
    return windows.trends(_events(spark, d), threshold=TREND)


@query(_counts_sql(60) + " SELECT window_end, key, n FROM c")
def stream_hourly_counts(spark, d):
    stream = windows.windowed_counts(_event_stream(spark, d).withWatermark("ts", LATE), "60 minutes")
    return sinks.drain_updates(stream, "hourly", ["window_end", "key"]).select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "key", "n")


@query(_counts_sql(60, _BOXED) + " SELECT window_end, key, n FROM c")
def stream_region_counts(spark, d):
    inside = windows.region_events(_event_stream(spark, d).withWatermark("ts", LATE), BOXES, "user_id", "value")
    return sinks.drain_updates(windows.windowed_counts(inside, "60 minutes"), "regions", ["window_end", "key"]).select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "key", "n")


# Append mode gives a window once the watermark, here the latest event, has passed its end.
@query(_counts_sql(10) + f""", p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY key ORDER BY window_end), 0)::BIGINT AS prev FROM z)
 SELECT * FROM p WHERE n >= {TREND} AND n >= 2 * prev AND window_end <= (SELECT max(ts) FROM events)""")
def stream_trend_alerts(spark, d):
    with windows.keyed_state(spark):
        seen = sinks.drain(windows.stream_trends(windows.stream_windowed_counts(_event_stream(spark, d, files=1), "10 minutes"), 600), "trends")
    return windows.trend_alerts(seen, TREND).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))

"""Registered queries over the pipeline operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import context_tree, decontaminate, language, packing, permutation_index, preference, simhash, substring_dedup, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query()
def op5_simhash_pivot_tables(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


# Bytes as pairs of hexadecimal digits, as DuckDB cuts text by characters alone.
_OP6 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT w, min(doc_id) AS first FROM p GROUP BY w), r AS (SELECT doc_id, i FROM p JOIN f USING (w) WHERE first < doc_id),
b AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS j FROM d)),
l AS (SELECT b.doc_id, j, x, max(i) OVER (PARTITION BY b.doc_id ORDER BY j) AS was FROM b LEFT JOIN r ON b.doc_id = r.doc_id AND j = i),
c AS (SELECT doc_id, j, x, coalesce(j - was < 50, false) AS gone FROM l), e AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM c),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, coalesce(string_agg(x, '' ORDER BY j) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""


@query(_OP6)
def op6_suffix_array_dedup(spark, d):
    return substring_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text")).drop("text")


_OP9 = """WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
b0 AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark),
b AS (SELECT item_id, ws, least(len(ws), 10) AS l FROM b0 WHERE len(ws) > 0),
bi AS (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM b),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l),
h AS (SELECT doc_id, i, di.l, item_id FROM di JOIN bw ON di.l = bw.l AND array_to_string(ws[i:i + di.l - 1], ' ') = g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query(_OP9)
def op9_positional_index_decontamination(spark, d):
    return decontaminate.decontaminate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


def _in_fold(n: int, which: int):
    """Whether crc32 of the doc_id leaves that remainder; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == which, F.lit(False)).alias("held_out")


@query()
def op2_language_viterbi(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", _in_fold(3, 1))
    model = language.train(docs.where(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), model)


@query()
def op8_order_preserving_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), with_ids=False)


@query()
def op7_context_tree_weighting(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", _in_fold(7, 2))
    return context_tree.score_texts(docs, ~F.col("held_out"))


@query("""WITH w AS (SELECT doc_id, crc32_fold, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM (SELECT doc_id, text, doc_id % 3 = 1 AS crc32_fold FROM documents)),
t AS (SELECT doc_id, crc32_fold, unnest(ws) AS w FROM w), c AS (SELECT w, count(*) AS c FROM t WHERE NOT crc32_fold GROUP BY w),
e AS (SELECT count(*) AS ends FROM w WHERE NOT crc32_fold), n AS (SELECT (coalesce(sum(c), 0) + any_value(ends))::BIGINT AS n, count(c) + 1 AS v, any_value(ends) AS ends FROM e LEFT JOIN c ON true),
s AS (SELECT doc_id, count(*) AS k, count(c.c) AS known, sum(log10(coalesce(c.c, 0) + 1)) AS lg FROM t LEFT JOIN c USING (w) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT + 1 AS n_tokens, coalesce(known, 0)::BIGINT + 1 AS n_known, n AS train_tokens, round(coalesce(lg, 0) + log10(ends + 1) - (len(ws) + 1) * log10(n + v + 1), 4) AS base_score FROM w LEFT JOIN s USING (doc_id), n""")
def unigram_base_scores(spark, d):
    """op7's base, with a fold that SQL can tell."""
    scored = context_tree.score_texts(table(spark, d, "documents").select("doc_id", "text"), F.pmod("doc_id", F.lit(3)) != 1)
    return scored.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


@query("""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest""")
def op3_warc_salvage(spark, d):
    return warc.round_trip(table(spark, d, "pages"))


@query("SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages WHERE page_id % 7 <> 3")
def salvaged_archives(spark, d):
    """What op3's reader recovers where every seventh record was damaged, and those without an id, which SQL's condition leaves out."""
    found = warc.drill(table(spark, d, "pages"), lambda page: page is None or (page >= 0 and page % 7 == 3))
    return found.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest")


@query()
def op4_permutation_index(spark, d):
    vectors = table(spark, d, "embeddings")
    return permutation_index.search(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))


# Fixed values of the contract.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _rules_sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    fits = ["(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1)) for _, r in ordered]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, (_, r) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{a}'" for f, (a, _) in zip(fits, ordered, strict=True))
    return f"""WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
k AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM k"""


@query(_rules_sql())
def op1_bloom_cascade_urls(spark, d):
    return url_filter.judge(table(spark, d, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_OP10 = """WITH t0 AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k FROM t0),
pairs AS (SELECT pair_id, max(CASE WHEN side = 0 THEN k ELSE 0 END) AS nc, max(CASE WHEN side = 1 THEN k ELSE 0 END) AS nr FROM t GROUP BY pair_id),
diff AS (SELECT a.pair_id, min(a.k) - 1 AS p FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1 WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
n AS (SELECT pair_id, coalesce(p, least(nc, nr)) AS n_prefix FROM pairs LEFT JOIN diff USING (pair_id)),
r AS (SELECT pair_id, side, k, n_prefix, role, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' AS body FROM t JOIN n USING (pair_id)),
o AS (SELECT *, sum(CASE WHEN k > n_prefix THEN length(head) + length(body) + 1 ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY k) - length(head) - length(body) - 1 + length(head) AS start FROM r),
g AS (SELECT pair_id, side, string_agg(CASE WHEN k <= n_prefix THEN head || body || chr(10) END, '' ORDER BY k) AS prompt,
  string_agg(CASE WHEN k > n_prefix THEN head || body || chr(10) END, '' ORDER BY k) AS rest,
  string_agg(CASE WHEN k > n_prefix AND role = 'assistant' THEN start::BIGINT || ':' || length(body) END, ',' ORDER BY k) AS mask FROM o GROUP BY pair_id, side)
SELECT n.pair_id, n.n_prefix::INTEGER AS n_prefix, coalesce(c.prompt, '') AS prompt, coalesce(c.rest, '') AS chosen_text, coalesce(c.mask, '') AS chosen_mask, coalesce(j.rest, '') AS rejected_text, coalesce(j.mask, '') AS rejected_mask
FROM n LEFT JOIN g c ON n.pair_id = c.pair_id AND c.side = 0 LEFT JOIN g j ON n.pair_id = j.pair_id AND j.side = 1"""


def _shown(pairs: DataFrame) -> DataFrame:
    """Formatted pairs, spans as ``start:length`` lists."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["length"].cast("string"))), ",")
    return preference.format_preferences(pairs).withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


@query(_OP10)
def op10_preference_pairs(spark, d):
    return _shown(preference.conversations_as_pairs(table(spark, d, "conversations")))


_SHARED = """WITH t1 AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t2 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY pair_id) AS n FROM t1),
t AS (SELECT pair_id, 0 AS side, role, text, k FROM t2 UNION ALL SELECT pair_id, 1, role, CASE WHEN k = n THEN 'No. ' || text ELSE text END, k FROM t2),
"""


@query(_SHARED + _OP10[_OP10.index("pairs AS") :])
def preference_shared_prompts(spark, d):
    """Each conversation against itself with another last turn: all turns but one are the prompt."""
    turns = F.col("chosen")
    other = F.struct(F.element_at(turns, -1)["role"].alias("role"), F.concat(F.lit("No. "), F.element_at(turns, -1)["text"]).alias("text"))
    chats = preference.conversations(table(spark, d, "conversations")).withColumnsRenamed({"conv_id": "pair_id", "turns": "chosen"})
    return _shown(chats.withColumn("rejected", F.concat(F.slice(turns, F.lit(1), F.size(turns) - 1), F.array(other))))

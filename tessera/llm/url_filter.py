"""URL filtering with a cascade of Bloom filters, in DataFrame functions alone.

The first filter holds the listed keys; the next holds the keys of the universe that the first takes for listed though
they aren't; the next the listed keys that the second takes for those, and so on until no error is left. The first
filter that lacks a key then tells: an odd one that it is not listed, an even one that it is. Over the whole key
universe (all keys of the corpus) that is exact, at a few bits a key.

A rule ``host/path`` fits its host and all subdomains, where the url's path starts with ``/path``. So a url has few candidate
keys: the last labels of its host with the first characters of its path, in the numbers that rules have. One cascade over all
urls' candidates tells which of them are rules, and the longest one decides; a second one over the rules tells which block.
Nothing else looks at the rules.

Filters are arrays of words read as scalar subqueries, so a lookup joins nothing. That holds while a filter has at most
``MAX_BITS`` (16 MB). A larger one is split to shards by key hash, and then only hashed distinct keys are dealt to the shards,
never rows; the listed ones among them go back to the rows by an equi-join that Spark may broadcast or split.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import cut

MAX_BITS, SHARD_BITS, FIRST_ERROR, ERROR = 1 << 27, 1 << 16, 0.02, 0.1
#: Looked up in the row itself; with more pairs of label and character counts keys are dealt as for large filters.
FORMS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Level:
    """One filter: (shard, words), each shard of ``bits`` bits, with ``hashes`` bits a key."""

    words: DataFrame
    bits: int
    hashes: int
    shards: int

    def present(self, words: Column, key: Column, number: int) -> Column:
        found = F.lit(True)
        for p in _places(key, number, self.bits, self.hashes):
            found = found & (F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        return found

    def passed(self, keys: DataFrame, number: int) -> DataFrame:
        """Those of (key) that the filter takes for its own."""
        if self.shards == 1:
            return keys.where(self.present(self.words.select("words").scalar(), F.col("key"), number))
        dealt = keys.withColumn("shard", _shard(F.col("key"), self.shards)).join(self.words, "shard")
        return dealt.where(self.present(F.col("words"), F.col("key"), number)).select("key")


@dataclass
class Cascade:
    levels: list[Level]

    @property
    def whole(self) -> bool:
        """Whether every filter is one array, so that a key is looked up where it is."""
        return all(level.shards == 1 for level in self.levels)

    def has(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe. Null is not."""
        listed = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels) - 1, -1, -1):
            level = self.levels[number]
            listed = F.when(level.present(level.words.select("words").scalar(), key, number), listed).otherwise(F.lit(number % 2 == 1))
        return key.isNotNull() & listed

    def listed(self, keys: DataFrame) -> DataFrame:
        """The listed ones of distinct (key), whatever the filters' size."""
        if self.whole:
            return keys.where(self.has(F.col("key")))
        found, live = None, keys
        for number, level in enumerate(self.levels):
            passed = cut(level.passed(live, number))
            if number % 2:  # what lacks in a filter of errors is listed
                told = live.join(passed, "key", "left_anti")
                found = told if found is None else found.unionByName(told)
            live = passed
        return found if len(self.levels) % 2 == 0 else live if found is None else found.unionByName(live)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits)) for j in range(hashes)]


def _encode(keys: DataFrame, number: int, count: int) -> Level:
    error = ERROR if number else FIRST_ERROR
    hashes = max(1, math.ceil(-math.log2(error)))
    wanted = math.ceil(count * hashes / math.log(2))
    shards = 1 if wanted <= MAX_BITS else math.ceil(wanted / SHARD_BITS)
    bits = 64 * math.ceil(max(64, wanted / shards * 1.1 if shards > 1 else wanted) / 64)
    placed = keys.select(_shard(F.col("key"), shards).alias("shard"), F.explode(F.array(*_places(F.col("key"), number, bits, hashes))).alias("p"))
    words = placed.groupBy("shard", F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(p, 64) AS INT))")).alias("bits"))
    empty = keys.sparkSession.range(shards * (bits // 64)).select(F.expr(f"id div {bits // 64}").alias("shard"), F.pmod("id", F.lit(bits // 64)).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    full = words.unionByName(empty).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    arrays = full.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
    return Level(cut(arrays), bits, hashes, shards)


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade over the keys of ``universe`` (key), repeats allowed, which tells those of ``listed`` (key); null keys are in neither.

    The universe is read once, by the first filter; what passes it, at most the listed keys and one in fifty others, is kept.
    """
    inside = cut(listed.where("key is not null").select("key").distinct())
    cascade, encode, against = Cascade([]), inside, universe.where("key is not null").select("key")
    for number in itertools.count():
        count = encode.count()
        if not count:
            return cascade
        level = _encode(encode, number, count)
        cascade.levels.append(level)
        passed = level.passed(against, number)
        passed = cut(passed.distinct().join(inside, "key", "left_anti") if number == 0 else passed)  # hot keys are one row a task before they are dealt
        encode, against = passed, encode
    raise AssertionError


def candidate(host: Column, path: Column, labels: int, size: int) -> Column:
    """The last so many labels of the host with the first so many characters of the path; null if the url is shorter."""
    fits = (F.regexp_count(host, F.lit(r"\.")) >= labels - 1) & (F.length(path) >= size)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns with these names are replaced.

    ``rules``: (action, rule), ``block`` or ``allow``, as pairs or a table; a rule given twice is to have one action (else it blocks).
    The longest rule that fits decides, ties to the smaller; where none fits, the verdict is ``allow``. Null urls and urls
    without ``://`` have an empty host and path, and rows are kept however often they repeat. Long urls cost no more than their
    labels and the longest rule's characters. Without rules nothing is blocked.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, rule string")
    rules = rules.where("rule is not null").select("action", F.col("rule").alias("key"))
    host, path = F.col("host"), F.col("path")
    base = pages.drop("host", "path", "rule", "verdict", "__row", "__first").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    name = F.substring_index("key", "/", 1)
    labels = (F.regexp_count(name, F.lit(r"\.")) + 1).alias("labels")
    forms = [tuple(r) for r in rules.select(labels, (F.length("key") - F.length(name)).alias("size")).distinct().collect()]
    if not forms:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keys = [candidate(host, path, *form) for form in sorted(forms)]
    placed = lambda key, *more: F.struct((-F.length(key)).alias("size"), key.alias("key"), *more)
    known = build_cascade(base.select(F.explode_outer(F.array(*keys)).alias("key")), rules)
    blocking = build_cascade(rules.select("key"), rules.where("action = 'block'").select("key"))
    if known.whole and blocking.whole and len(forms) <= FORMS:
        fitting = F.array_compact(F.array(*[F.when(known.has(k), placed(k)) for k in keys]))
        found = base.withColumn("rule", F.array_min(fitting)["key"])
        return found.withColumn("verdict", F.when(blocking.has(F.col("rule")), "block").otherwise("allow"))
    rows = cut(base.withColumn("__row", F.monotonically_increasing_id()))
    asked = rows.select("__row", F.explode_outer(F.array_distinct(F.array(*keys))).alias("key")).where("key is not null")
    met = cut(known.listed(asked.select("key").distinct()))
    told = met.join(blocking.listed(met).withColumn("blocks", F.lit(True)), "key", "left")
    first = asked.join(told, "key").groupBy("__row").agg(F.min(placed(F.col("key"), F.col("blocks"))).alias("__first"))
    joined = rows.join(first, "__row", "left")
    return joined.withColumns({"rule": F.col("__first.key"), "verdict": F.when(F.col("__first.blocks"), "block").otherwise("allow")}).drop("__row", "__first")

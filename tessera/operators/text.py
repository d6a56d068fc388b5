"""Counting words, followers and bigrams. Inputs are line tables with a ``line`` column.

Arrays are exploded by outer generators whose null rows are dropped right after: for inner ones the optimizer adds filters
on the array's size, in which the tokenizer would run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bigrams, tokenize


def word_count(lines: DataFrame) -> DataFrame:
    """(word, n): how often each token occurs."""
    return lines.select(F.explode_outer(tokenize(F.col("line"))).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))


def _bigrams(lines: DataFrame) -> DataFrame:
    return lines.select(tokenize(F.col("line")).alias("tokens")).select(F.inline_outer(bigrams(F.col("tokens"))).alias("x", "y")).where("x is not null")


def follower_count(lines: DataFrame, trigger: str, above: int = 1) -> DataFrame:
    """(word, n): tokens right after ``trigger`` on a line, those seen more than ``above`` times."""
    return _bigrams(lines).where(F.col("x") == trigger).groupBy(F.col("y").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") > above)


def bigram_count(lines: DataFrame) -> DataFrame:
    """(x, y, n): adjacent pairs within a line."""
    return _bigrams(lines).groupBy("x", "y").agg(F.count("*").alias("n"))


def relative_frequency_pairs(lines: DataFrame, marginals: bool = True) -> DataFrame:
    """(x, y, value): f(y|x) for each bigram, and with ``marginals`` a row (x, '*', count) for each x.

    One scan: the counts are dealt by x once, summed there, and the first row of an x brings its marginal along.
    """
    of_x = Window.partitionBy("x")
    counts = bigram_count(lines).select("x", "y", "n", F.sum("n").over(of_x).alias("total"), F.row_number().over(of_x.orderBy("y")).alias("k"))
    share = F.struct(F.col("y"), (F.col("n") / F.col("total")).alias("value"))
    if not marginals:
        return counts.select("x", share.alias("s")).select("x", "s.y", "s.value")
    marginal = F.when(F.col("k") == 1, F.struct(F.lit("*").alias("y"), F.col("total").cast("double").alias("value")))
    return counts.select("x", F.explode_outer(F.array(share, marginal)).alias("s")).where("s is not null").select("x", "s.y", "s.value")


def relative_frequency_stripes(lines: DataFrame) -> DataFrame:
    """(x, stripe): for each x a map from y to f(y|x). Counts are summed as pairs first; a stripe holds distinct y only."""
    entry = F.struct(F.col("y").alias("key"), F.col("value"))
    return relative_frequency_pairs(lines, marginals=False).groupBy("x").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("stripe"))

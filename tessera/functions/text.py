"""Token-level column expressions. None takes a lambda, so none is interpreted row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the first a-z of a run without white space to its last one.
TOKEN = r"[a-z](?:[^ \t\n\r\f]*[a-z])?"


def tokenize(text: Column) -> Column:
    """Lower-case words between spaces, tabs, LF, CR and FF, less what is not a-z at both ends; empty ones go. Null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def first_tokens(tokens: Column, limit: int) -> Column:
    """The first ``limit`` tokens, before any deduplication."""
    return F.slice(tokens, 1, limit)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs as an array of two-field structs, for :func:`inline_outer`; empty for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n))


def pmi(cxy: Column, cx: Column, cy: Column, n: Column) -> Column:
    """log10(c(x,y) * N / (c(x) * c(y))), in double precision."""
    return F.log10(cxy.cast("double") * n / (cx.cast("double") * cy))


def abbreviate(line: Column, width: int = 80) -> Column:
    """Lines longer than ``width`` are cut and end in three dots."""
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)

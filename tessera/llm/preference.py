"""Preference formatting: pairs of conversations as one prompt and two masked completions, in DataFrame functions alone.

The longest common prefix of turns (role and text equal) is rendered once, as the prompt; what follows on each side is its
completion. A completion's mask lists the spans, in characters, that count for training: the texts of assistant turns
with their end marks. Equal conversations have empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END, TRAINED = "<|end|>", "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(TURN_END + "\n"))), "")


def _mask(turns: Column) -> Column:
    """array<struct<start,length>> of the trained spans of the rendered turns."""
    none = F.array().cast("array<struct<start:int,length:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(t["text"]) + len(TURN_END)
        span = F.struct((acc["at"] + head).cast("int").alias("start"), body.cast("int").alias("length"))
        spans = F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, n).otherwise(differs - 1).cast("int")


def _turn() -> Column:
    return F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _in_order(turns: Column) -> Column:
    """Collected turns as array<struct<role,text>>, by turn, then role and text."""
    return F.transform(F.sort_array(turns), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): turns of one number by role and text, null numbers first, null roles ``unknown``, null texts empty; rows without conv_id go."""
    return turns.where("conv_id is not null").groupBy("conv_id").agg(_in_order(F.collect_list(_turn())).alias("turns"))


def conversations_as_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversation 2p is preferred to 2p + 1.

    A side is its turns as array<struct<role,text>>, by turn, then role and text where a turn number repeats; null turns
    come first, null roles are ``unknown``, null texts empty. A missing side has no turns. Rows without conv_id belong to none;
    repeated rows are turns of their own. Other columns are not read. An empty table gives no pairs.
    """
    side = lambda odd: _in_order(F.collect_list(F.when(F.pmod("conv_id", F.lit(2)) == odd, _turn())))
    pair = F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id")
    return turns.where("conv_id is not null").groupBy(pair).agg(side(0).alias("chosen"), side(1).alias("rejected"))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The pairs' other columns with n_prefix, prompt, chosen_text, chosen_mask, rejected_text and rejected_mask.

    Null sides count as conversations without turns; texts of any length are rendered whole. Columns with a result's name are replaced.
    """
    made = ("n_prefix", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.drop(*made).withColumns({chosen: F.coalesce(chosen, none), rejected: F.coalesce(rejected, none)})
    n = F.col("n_prefix")
    rest = lambda side: F.slice(F.col(side), n + 1, F.size(side))
    return sides.withColumn("n_prefix", common_prefix(F.col(chosen), F.col(rejected))).withColumns(
        {
            "prompt": _rendered(F.slice(F.col(chosen), F.lit(1), n)),
            "chosen_text": _rendered(rest(chosen)), "chosen_mask": _mask(rest(chosen)),
            "rejected_text": _rendered(rest(rejected)), "rejected_mask": _mask(rest(rejected)),
        }
    ).drop(chosen, rejected)

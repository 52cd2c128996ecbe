"""Preference formatting of chosen and rejected conversations.

Turns of both sides are numbered from 0 by ``turn``. The longest common prefix of turns (equal role and text) is rendered once as
the prompt; what follows on each side is rendered as that side's completion, with a mask of spans [start, end) in code
points of the completion that a loss may count: the texts of the target role's turns and their end marks.

Defined cases: null roles and texts count as empty; pairs of which one side has no turns get an empty prompt and an
empty completion there; equal sides keep both completions empty; repeated turns are kept, in the order of their role
and text where ``turn`` ties or is null (nulls first); turns without key are of no conversation and are left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, BREAK, STOP = "<|start|>", "\n", "<|end|>\n"


def _ordered_turns(turns: DataFrame, key: str, side: str) -> DataFrame:
    """One row per key: its turns as an array of (role, text) in order."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turn = F.struct(F.col("turn"), text("role"), text("text"))
    role_text = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    return turns.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(turn)), role_text).alias(side))


def _common(a: Column, b: Column) -> Column:
    """How many leading turns agree."""
    short = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), short), lambda i: (i < short) & (F.get(a, i) != F.get(b, i)))
    return F.coalesce(F.get(differs, F.lit(0)), short)


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(START), x["role"], F.lit(BREAK), x["text"], F.lit(STOP))), "")


def _mask(turns: Column, target: str) -> Column:
    """Spans of the target role's texts and end marks in the rendering of turns."""
    head = lambda x: F.length(x["role"]) + len(START) + len(BREAK)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + head(x)
        end = start + F.length(x["text"]) + len(STOP)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == target, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str, target: str = "assistant") -> DataFrame:
    """One row per key in chosen or rejected (key, turn, role, text): prompt, n_prefix, both completions and masks."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = _ordered_turns(chosen, key, "chosen").join(_ordered_turns(rejected, key, "rejected"), key, "full")
    both = both.withColumns({side: F.coalesce(side, none) for side in ("chosen", "rejected")})
    both = both.withColumn("n_prefix", _common(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(side, F.col("n_prefix") + 1, F.size(side))
    return both.select(
        key, F.col("n_prefix").cast("long").alias("n_prefix"), _render(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        *[_render(rest(side)).alias(f"{side}_completion") for side in ("chosen", "rejected")],
        *[_mask(rest(side), target).alias(f"{side}_mask") for side in ("chosen", "rejected")],
    )


def swapped_replies(conversations: DataFrame, target: str = "assistant", ranges: int = 256) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides for a table without ratings: every conversation that has a target turn, and the same
    conversation with its last target turn's text replaced by that of the next such conversation (the last takes the first's)."""
    turns = conversations.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    replies = turns.filter(F.col("role") == target).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    replies = replies.select("conv_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"))
    # the next conversation: within a range of ids by a window, across ranges by the ranges' first rows; ranges of about equal numbers of rows
    bounds = replies.agg(F.percentile_approx("conv_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    held = F.lit(np.array(sorted(set(bounds)) or [0], np.int64))
    placed = replies.withColumn("range", F.size(F.filter(held, lambda b: b < F.col("conv_id"))))
    firsts = placed.groupBy("range").agg(F.min_by("last_text", "conv_id").alias("first_text"))  # at most `ranges` rows
    cycle = Window.orderBy("range")
    whole = cycle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("range", F.coalesce(F.lead("first_text").over(cycle), F.first("first_text").over(whole)).alias("following"))
    inside = placed.withColumn("other", F.lead("last_text").over(Window.partitionBy("range").orderBy("conv_id")))
    swap = inside.join(F.broadcast(following), "range").select("conv_id", "last_turn", F.coalesce("other", "following").alias("other"))
    with_other = turns.join(swap, "conv_id")
    is_last = (F.col("role") == target) & F.col("turn").eqNullSafe(F.col("last_turn"))
    rejected = with_other.select("conv_id", "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text"))
    return with_other.select("conv_id", "turn", "role", "text"), rejected


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_preferences(*swapped_replies(table(spark, sf_dir, "conversations")), "conv_id")
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return out.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


#: The same rows by joins and string aggregates.
OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last_turn, max_by(text, turn) AS last_text FROM t WHERE role = 'assistant' GROUP BY conv_id),
swap AS (SELECT conv_id, last_turn, coalesce(lead(last_text) OVER (ORDER BY conv_id), first_value(last_text) OVER (ORDER BY conv_id)) AS other FROM last),
sides AS (
  SELECT conv_id, turn, role, text AS a, CASE WHEN role = 'assistant' AND turn = last_turn THEN other ELSE text END AS b,
         '<|start|>' || role || chr(10) AS head
  FROM t JOIN swap USING (conv_id)),
cut AS (SELECT conv_id, coalesce(min(CASE WHEN a <> b THEN turn END), max(turn) + 1) AS first_diff FROM sides GROUP BY conv_id),
placed AS (
  SELECT conv_id, turn, role, head, a, b, turn < first_diff AS common,
    sum(CASE WHEN turn >= first_diff THEN length(head) + length(a) + 8 ELSE 0 END) OVER w AS a_end,
    sum(CASE WHEN turn >= first_diff THEN length(head) + length(b) + 8 ELSE 0 END) OVER w AS b_end
  FROM sides JOIN cut USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) FILTER (common) AS n_prefix,
  coalesce(string_agg(head || a || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (common), '') AS prompt,
  coalesce(string_agg(head || a || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (NOT common), '') AS chosen_completion,
  coalesce(string_agg(head || b || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (NOT common), '') AS rejected_completion,
  coalesce(string_agg(CAST(CAST(a_end - length(a) - 8 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a_end AS BIGINT) AS VARCHAR), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(b_end - length(b) - 8 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b_end AS BIGINT) AS VARCHAR), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""

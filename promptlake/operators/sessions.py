"""Signals between the prompts of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .finops import r


def words(text: Column) -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def session_signals(prompts: DataFrame, alike: float = 0.65, soon: int = 30, later: int = 60) -> DataFrame:
    """Each prompt (conv_id, turn, t_sec, text) against the one before it: a reformulation within ``soon`` seconds if alike, or else a continuation within ``later``."""
    w = Window.partitionBy("conv_id").orderBy("t_sec")
    p = prompts.withColumn("w", words(F.col("text")))
    p = p.withColumns({"gap": F.col("t_sec") - F.lag("t_sec").over(w), "similarity": overlap(F.col("w"), F.lag("w").over(w))})
    again = (F.col("similarity") >= alike) & (F.col("gap") <= soon)
    signal = F.when(F.col("gap").isNull(), "first").when(again, "reformulation").when(F.col("gap") <= later, "continuation").otherwise("none")
    return p.select("conv_id", "turn", "gap", r(F.col("similarity")).alias("similarity"), signal.alias("signal"))


def signal_weight(signal: Column) -> Column:
    return F.when(signal == "reformulation", 0.2).when(signal == "continuation", 0.85).otherwise(0.5)

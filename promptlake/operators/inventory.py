"""Prompt inventory, knowledge and profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .finops import r


def prompt_inventory(events: DataFrame) -> DataFrame:
    return events.groupBy("prompt_key").agg(
        F.count("*").alias("uses"), r(F.sum("cost_usd")).alias("cost"), r(F.avg("savings_percent")).alias("avg_savings"), F.sum("input_tokens").alias("tokens"), F.max("model").alias("model")
    )


def top_prompts(inventory: DataFrame, k: int) -> DataFrame:
    """The k first prompts by use, by cost and by savings, each list ranked."""
    kinds = {"most_used": "uses", "most_expensive": "cost", "most_compressible": "avg_savings"}
    ranked = [inventory.orderBy(F.desc(c), "prompt_key").limit(k).select(F.lit(kind).alias("list"), "prompt_key", F.row_number().over(Window.orderBy(F.desc(c), "prompt_key")).cast("long").alias("rank")) for kind, c in kinds.items()]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


def inventory_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("prompt_key").alias("unique_prompts"), F.count("*").alias("uses"), r(F.sum("cost_usd")).alias("cost"), r(F.avg("savings_percent")).alias("avg_savings"))


def knowledge_search(terms: DataFrame, needle: str) -> DataFrame:
    """Terms (category, term, definition) whose name or definition contains the needle, any case."""
    low = lambda c: F.contains(F.lower(c), F.lit(needle.lower()))
    return terms.filter(low("term") | low("definition")).select("category", "term", "definition").orderBy("category", "term")


def knowledge_summary(terms: DataFrame) -> DataFrame:
    return terms.groupBy("category").agg(F.count("*").alias("terms"), F.sum("validated").alias("validated"))


def profile_map(profiles: DataFrame) -> DataFrame:
    """Key-value rows (user_id, key, value) as one map per user, rendered in the order of its keys."""
    entries = F.sort_array(F.collect_list(F.struct("key", "value")))
    as_text = lambda e: F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return profiles.groupBy("user_id").agg(as_text(entries).alias("profile"), F.count("*").alias("n_keys"))


def compact_profile(profiles: DataFrame, k: int) -> DataFrame:
    """The k keys of highest confidence per user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("confidence"), "key")
    return profiles.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def history_stats(events: DataFrame, days: int) -> DataFrame:
    """Optimizations by day over the last days, with rounded means."""
    from .finops import day, last_days

    return last_days(events, days).groupBy(day()).agg(F.count("*").alias("n"), F.round(F.avg("savings_percent"), 1).alias("avg_savings"), F.sum("input_tokens").alias("tokens"))

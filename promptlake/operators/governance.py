"""Policies, compliance, routing, caching, experiments and service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .finops import r


def evaluate_policies(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Each request (id, model, provider, input_tokens) under all enabled policies (name, rule_type, subject, amount): a small, fixed table."""
    denies = (
        ((F.col("rule_type") == "deny_model") & (F.col("model") == F.col("subject")))
        | ((F.col("rule_type") == "limit_provider") & (F.col("provider") != F.col("subject")))
        | ((F.col("rule_type") == "max_tokens") & (F.col("input_tokens") > F.col("amount")))
    )
    acts = denies | F.col("rule_type").isin("force_compression", "force_cache")
    hit = requests.join(F.broadcast(policies.filter("enabled = 1")), acts, "left")
    return hit.groupBy("id").agg(
        F.coalesce(F.bool_and(~denies), F.lit(True)).alias("allowed"),
        F.array_join(F.sort_array(F.collect_list("name")), ",").alias("policies"),
        F.coalesce(F.bool_or(F.col("rule_type") == "force_compression"), F.lit(False)).alias("force_compression"),
    )


def compliance(configs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements (framework, setting, wanted) against a tenant's configuration (setting, value), a small table."""
    got = requirements.join(F.broadcast(configs), "setting", "left").withColumn("passed", F.coalesce(F.col("value") == F.col("wanted"), F.lit(False)))
    return got.groupBy("framework").agg(F.every("passed").alias("compliant"), F.sum(F.when(~F.col("passed"), 1).otherwise(0)).alias("failed"))


def latest_status(log: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """State of each key from its log of changes."""
    return log.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in columns], F.count("*").alias("changes"))


def route(denied: Column, cached: Column, chars: Column, tokens: Column, forced: Column) -> Column:
    """What the gateway does with a request: the first rule that applies."""
    return F.when(denied, "deny").when(cached, "cache_hit").when(chars > 2000, "compress_industrial").when((chars > 200) | forced, "compress_balanced").when(tokens < 50, "bypass").otherwise("compress")


def cache_frequency(prompts: DataFrame) -> DataFrame:
    """Whether a prompt is worth caching: at least 30 characters, and seen twice or longer than 500. The key takes the head of the text, as a cache's key does."""
    key = F.substring(F.sha2(F.concat_ws(":", "model", F.substring("text", 1, 500)), 256), 1, 16)
    by = prompts.groupBy(key.alias("cache_key")).agg(F.count("*").alias("uses"), F.max(F.length("text")).cast("long").alias("chars"))
    return by.withColumn("use_cache", (F.col("chars") >= 30) & ((F.col("uses") >= 2) | (F.col("chars") > 500)))


def variant(experiment: str, user: Column) -> Column:
    """Deterministic assignment of a user: the first 32 bits of a digest, modulo 100, under 50."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(experiment + ":"), user), 256), 1, 8), 16, 10).cast("long")
    return F.when(h % 100 < 50, "A").otherwise("B")


def experiment_results(events: DataFrame, experiment: str) -> DataFrame:
    """Per variant counts and means, and which costs less (on a tie the second)."""
    by = events.withColumn("variant", variant(experiment, F.col("user_id"))).groupBy("variant").agg(
        F.count("*").alias("n"), F.round(F.avg("cost_usd"), 6).alias("avg_cost"), F.round(F.avg("savings_percent"), 3).alias("avg_quality"), F.round(F.avg("input_tokens"), 1).alias("avg_tokens")
    )
    pair = Window.partitionBy()  # two rows
    wins = F.when(F.count("*").over(pair) == 2, F.max(F.struct((-F.col("avg_cost")).alias("c"), F.col("variant").alias("variant"))).over(pair)["variant"])
    return by.withColumn("winner", wins)


def request_metrics(events: DataFrame) -> DataFrame:
    failed = F.when(F.col("status") >= 400, 1).otherwise(0)
    return events.groupBy("endpoint").agg(F.count("*").alias("requests"), F.sum(failed).alias("errors"), r(F.avg("duration_ms")).alias("avg_ms"), r(F.max("duration_ms")).alias("max_ms"))


def latency_ema(events: DataFrame, keep: float = 0.9) -> DataFrame:
    """Exponential moving average of durations by endpoint, from 0, in order of time.

    Unrolled: the i-th of n durations weighs (1 - keep) * keep ** (n - i), so sums do what a fold over the ordered list would.
    """
    w = Window.partitionBy("endpoint").orderBy(F.desc("at"), F.desc("id"))
    back = events.withColumn("back", F.row_number().over(w) - 1)
    return back.groupBy("endpoint").agg(r(F.sum(F.col("duration_ms") * (1 - keep) * F.pow(F.lit(keep), F.col("back"))), 4).alias("ema_ms"))


def recent_traces(events: DataFrame, k: int) -> DataFrame:
    """The k latest requests of each endpoint."""
    w = Window.partitionBy("endpoint").orderBy(F.desc("at"), F.desc("id"))
    return events.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("endpoint", "id", "rank")


def compression_metrics(requests: DataFrame) -> DataFrame:
    saved = F.sum(F.col("tokens_original") - F.col("tokens_compressed"))
    return requests.agg(
        F.count("*").alias("requests"), saved.alias("tokens_saved"), F.sum(F.when(F.col("rate") == 0, 1).otherwise(0)).alias("fallbacks"),
        F.round(100 * saved / F.sum("tokens_original"), 1).alias("saved_percent"), F.max_by("savings_percent", F.struct("created_at", "id")).alias("last_savings"),
    )


def exposition(metrics: DataFrame) -> DataFrame:
    """Metrics (endpoint, requests, errors) as lines of the text exposition format."""
    line = lambda name, c: F.concat(F.lit(name + '{endpoint="'), "endpoint", F.lit('"} '), F.col(c).cast("string"))
    return metrics.select(F.explode(F.array(line("requests_total", "requests"), line("errors_total", "errors"))).alias("line"))

"""Cost analytics over prompt events: summaries, trends, anomalies, forecasts, return on investment, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import RATES


def last_days(events: DataFrame, days: int, at: str = "created_at") -> DataFrame:
    """Rows of the days before the latest row. The latest time joins as a one-row aggregate."""
    latest = events.agg(F.max(at).alias("_latest"))
    return events.join(F.broadcast(latest), F.col(at) >= F.col("_latest") - F.expr(f"INTERVAL {days} DAYS")).drop("_latest")


def day(at: str = "created_at") -> Column:
    return F.date_format(at, "yyyy-MM-dd").alias("day")


def r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def cost_summary(events: DataFrame, days: int) -> DataFrame:
    return last_days(events, days).groupBy("provider", "model").agg(
        r(F.sum("cost_usd")).alias("cost"), F.sum("input_tokens").alias("tokens"), F.count("*").alias("requests"), r(F.avg("savings_percent")).alias("avg_savings")
    )


def cost_totals(summary: DataFrame) -> DataFrame:
    """Totals of a cost summary with cost per token and per request."""
    total = summary.agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"))
    return total.select(
        r(F.col("cost")).alias("total_cost"), F.col("tokens").alias("total_tokens"), F.col("requests").alias("total_requests"),
        r(F.coalesce(F.try_divide("cost", "tokens"), F.lit(0.0)), 6).alias("cost_per_token"), r(F.coalesce(F.try_divide("cost", "requests"), F.lit(0.0)), 4).alias("cost_per_request"),
    )


def top_costly_prompts(events: DataFrame, k: int) -> DataFrame:
    by = events.groupBy("prompt_key").agg(r(F.sum("cost_usd")).alias("cost"), F.count("*").alias("uses"), F.max("model").alias("model"))
    return by.orderBy(F.desc("cost"), "prompt_key").limit(k)


def cost_trend(events: DataFrame, days: int) -> DataFrame:
    return last_days(events, days).groupBy(day()).agg(r(F.sum("cost_usd")).alias("cost"), F.sum("input_tokens").alias("tokens"), F.count("*").alias("requests"))


def top_users(events: DataFrame, days: int, k: int) -> DataFrame:
    by = last_days(events, days).groupBy("user_id").agg(
        r(F.sum("cost_usd")).alias("cost"), F.sum("input_tokens").alias("tokens"), F.count("*").alias("requests"), r(F.avg("savings_percent")).alias("avg_savings")
    )
    return by.orderBy(F.desc("cost"), "user_id").limit(k)


def provider_efficiency(events: DataFrame, days: int) -> DataFrame:
    by = last_days(events, days).groupBy("provider").agg(F.sum("cost_usd").alias("c"), F.sum("input_tokens").alias("tokens"), F.count("*").alias("requests"))
    return by.select("provider", r(F.col("c")).alias("cost"), "tokens", "requests", F.round(F.coalesce(F.try_divide("c", "tokens"), F.lit(0.0)), 8).alias("cost_per_token"))


def daily_spikes(events: DataFrame, z: float = 2.5, critical: float = 3.5, days: int = 30) -> DataFrame:
    """Days whose cost lies z population deviations or more over the mean day, of at least five days."""
    daily = last_days(events, days).groupBy(day()).agg(F.sum("cost_usd").alias("cost"))
    stats = daily.agg(F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("sd"), F.count("*").alias("n"))
    scored = daily.join(F.broadcast(stats), (F.col("n") >= 5) & (F.col("sd") > 0)).withColumn("score", (F.col("cost") - F.col("mean")) / F.col("sd"))
    return scored.filter(F.col("score") >= z).select(
        "day", r(F.col("cost")).alias("cost_usd"), F.round("score", 2).alias("z_score"), F.lit("cost_spike").alias("type"),
        F.when(F.col("score") >= critical, "critical").otherwise("warning").alias("severity"),
    )


def user_drift(events: DataFrame, times: float = 3.0, days: int = 7) -> DataFrame:
    """Users whose cost exceeds ``times`` the median user's."""
    by = last_days(events, days).groupBy("user_id").agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("requests"))
    middle = by.agg(F.median("cost").alias("middle"), F.count("*").alias("n"))
    out = by.join(F.broadcast(middle), (F.col("n") >= 2) & (F.col("middle") > 0) & (F.col("cost") > F.col("middle") * times))
    return out.select("user_id", r(F.col("cost")).alias("cost_usd"), "requests", F.lit("user_drift").alias("type"), F.round(F.col("cost") / F.col("middle"), 1).alias("ratio_vs_median"))


def anomaly_scan(events: DataFrame, z: float = 2.5, times: float = 3.0) -> DataFrame:
    return daily_spikes(events, z).unionByName(user_drift(events, times), allowMissingColumns=True)


def forecast(events: DataFrame, horizon: str, horizon_days: int) -> DataFrame:
    """Spend over a horizon from the daily mean, leaned by half the trend between the first and the last seven days."""
    daily = last_days(events, min(horizon_days, 90)).groupBy(day()).agg(F.sum("cost_usd").alias("cost"))
    history = daily.agg(F.sort_array(F.collect_list(F.struct("day", "cost"))).alias("days"))  # one row per day of at most 90
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["cost"]) / F.size(a)
    out = history.select(F.size("days").alias("n"), mean(F.col("days")).alias("avg"), mean(F.slice("days", F.greatest(F.size("days") - 6, F.lit(1)), 7)).alias("recent"), mean(F.slice("days", 1, 7)).alias("older"))
    trend = F.when((F.col("n") >= 7) & (F.col("older") != 0), (F.col("recent") - F.col("older")) / F.col("older")).otherwise(0.0)
    return out.select(
        F.lit(horizon).alias("horizon"), F.round(F.col("avg") * horizon_days * (1 + trend * 0.5), 2).alias("projected_usd"), F.round("avg", 4).alias("daily_avg_usd"),
        F.round(trend * 100, 1).alias("trend_percent"), F.when(F.col("n") >= 14, "high").when(F.col("n") >= 7, "medium").otherwise("low").alias("confidence"), F.col("n").cast("long").alias("data_points"),
    )


def roi(events: DataFrame, days: int, fee_per_1k: float = 0.002, assumed_rate: float | None = None) -> DataFrame:
    """Savings against the spend without compression, less the fee on all tokens."""
    kept = F.col("compressed") == 1
    saved = F.when(F.col("savings_percent") >= 99, 0.99).otherwise(F.col("savings_percent") / 100.0)
    s = last_days(events, days).agg(
        F.sum("cost_usd").alias("actual"), F.sum(F.when(kept, F.col("cost_usd") / (1.0 - saved)).otherwise(F.col("cost_usd"))).alias("before"),
        F.sum("input_tokens").alias("tokens"), F.avg(F.when(kept, F.col("savings_percent")).otherwise(0.0)).alias("savings"),
    )
    if assumed_rate is not None:
        s = s.withColumn("before", F.col("actual") / (1.0 - max(0.0, min(0.99, assumed_rate))))
    s = s.withColumns({"gross": F.greatest(F.col("before") - F.col("actual"), F.lit(0.0)), "fee": F.col("tokens") / 1000 * fee_per_1k})
    s = s.withColumn("net", F.col("gross") - F.col("fee"))
    return s.select(
        F.round("before", 2).alias("baseline_cost_usd"), F.round("actual", 2).alias("optimized_cost_usd"), F.round("gross", 2).alias("gross_savings_usd"), F.round("fee", 2).alias("fee_usd"), F.round("net", 2).alias("net_roi_usd"),
        F.round(F.coalesce(F.try_divide(F.col("net"), F.col("fee")) * 100, F.lit(0.0)), 1).alias("roi_percent"), F.col("tokens").alias("total_tokens"), F.round("savings", 1).alias("avg_savings_percent"),
        F.when(F.col("net") > 0, "positive").otherwise("neutral").alias("verdict"),
    )


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert semantics: the last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")  # combines before the exchange
    return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in rows.columns])


def budget_status(budgets: DataFrame, spend: DataFrame, add: float = 0.0) -> DataFrame:
    """Budgets (scope_id, amount_usd, alert_threshold) against spend (scope_id, spent_usd); a scope without spend has spent 0."""
    b = budgets.join(spend, "scope_id", "left").withColumn("spent_usd", F.coalesce("spent_usd", F.lit(0.0)))
    after = F.col("spent_usd") + add
    use = F.coalesce(F.try_divide(F.col("spent_usd"), F.col("amount_usd")), F.lit(0.0))
    return b.select("scope_id", r(F.col("amount_usd")).alias("amount_usd"), r(F.col("spent_usd")).alias("spent_usd"), (after <= F.col("amount_usd")).alias("allowed"), F.round(use, 3).alias("utilization"), (use >= F.col("alert_threshold")).alias("alert"))


def budget_alerts(status: DataFrame) -> DataFrame:
    return status.filter("alert")


def executive_breakdown(events: DataFrame, days: int) -> DataFrame:
    """Costs by model, by provider and in all, in one pass."""
    by = last_days(events, days).rollup("provider", "model").agg(r(F.sum("cost_usd")).alias("cost"), F.count("*").alias("requests"), F.grouping_id().alias("level"))
    return by.select(F.coalesce("provider", F.lit("all")).alias("provider"), F.coalesce("model", F.lit("all")).alias("model"), "cost", "requests", F.col("level").cast("long").alias("level"))


def period_change(events: DataFrame, days: int = 30) -> DataFrame:
    """This period's cost and the one before it: the last 2 * days less the last days."""
    both = last_days(events, 2 * days).agg(F.sum("cost_usd").alias("both"))
    now = last_days(events, days).agg(F.sum("cost_usd").alias("now"))
    return now.join(both).select(r(F.col("now")).alias("current_cost"), r(F.col("both") - F.col("now")).alias("previous_cost"))


def cost_simulation(prompts: DataFrame, prices: DataFrame) -> DataFrame:
    """What each prompt (prompt_key, tokens) would cost on every model of the fixed price list, output as long as input."""
    priced = prompts.select("prompt_key", "tokens", F.explode(prices_array(prices)).alias("p"))
    return priced.select("prompt_key", "p.model", r(F.col("tokens") / 1000.0 * F.col("p.in_price") + F.col("tokens") / 1000.0 * F.col("p.out_price"), 8).alias("cost_usd"))


def prices_array(prices: DataFrame) -> Column:
    """The price list, a fixed table of a few rows, as a literal array."""
    rows = prices.collect()
    return F.array(*[F.struct(F.lit(p["model"]).alias("model"), F.lit(p["in_price"]).alias("in_price"), F.lit(p["out_price"]).alias("out_price")) for p in rows])


def first_row(rows: DataFrame, key: str) -> DataFrame:
    """The row with the least key."""
    return rows.orderBy(key).limit(1)


def apply_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows after changes (the same columns and op: insert, update or delete; one change per key). What a change names is replaced or left out."""
    kept = rows.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.filter("op <> 'delete'").drop("op"))


def seeded_requests(spark: SparkSession, n: int) -> DataFrame:
    """n requests whose numbers come from digests of their ids, the same in every run and on every cluster."""
    def number(name: str) -> Column:
        return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")

    rates = F.array(*[F.lit(x) for x in RATES])
    return spark.range(n).select("id", (number("user") % 40).alias("user_id"), (number("tokens") % 4000 + 20).alias("tokens"), F.get(rates, (number("rate") % 6).cast("int")).alias("rate"))

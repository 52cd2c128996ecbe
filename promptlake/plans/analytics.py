"""Queries of the analytics operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decision as de
from ..operators import finops as fo
from ..operators import governance as go
from ..operators import inventory as inv
from ..operators import sessions as se
from ..sources import tables as t
from .registry import query

E, R, C = t.PROMPT_EVENTS_SQL, t.REQUESTS_SQL, t.CELLS_SQL


def _last(days: int) -> str:
    return f"e AS (SELECT * FROM ({E}) x WHERE created_at >= (SELECT max(ts) FROM events WHERE value IS NOT NULL) - INTERVAL {days} DAYS)"


DAY = "strftime(created_at, '%Y-%m-%d')"
_SUMMARY = "SELECT provider, model, round(sum(cost_usd), 6) AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(*) AS requests, round(avg(savings_percent), 6) AS avg_savings FROM e GROUP BY ALL"


@query(E)
def a01_prompt_events(spark: SparkSession, d: str) -> DataFrame:
    return t.prompt_events(spark, d)


@query(f"WITH {_last(30)} {_SUMMARY}")
def b01_cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return fo.cost_summary(t.prompt_events(spark, d), 30)


@query(f"WITH {_last(30)}, s AS ({_SUMMARY}) SELECT round(sum(cost), 6) AS total_cost, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(sum(requests) AS BIGINT) AS total_requests, round(sum(cost) / sum(tokens), 6) AS cost_per_token, round(sum(cost) / sum(requests), 4) AS cost_per_request FROM s")
def b01_cost_totals(spark: SparkSession, d: str) -> DataFrame:
    return fo.cost_totals(fo.cost_summary(t.prompt_events(spark, d), 30))


@query(f"SELECT prompt_key, round(sum(cost_usd), 6) AS cost, count(*) AS uses, max(model) AS model FROM ({E}) e GROUP BY 1 ORDER BY cost DESC, prompt_key LIMIT 20")
def b02_top_costly_prompts(spark: SparkSession, d: str) -> DataFrame:
    return fo.top_costly_prompts(t.prompt_events(spark, d), 20)


@query(f"WITH {_last(30)} SELECT {DAY} AS day, round(sum(cost_usd), 6) AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(*) AS requests FROM e GROUP BY 1")
def b03_cost_trend(spark: SparkSession, d: str) -> DataFrame:
    return fo.cost_trend(t.prompt_events(spark, d), 30)


@query(f"WITH {_last(30)} SELECT user_id, round(sum(cost_usd), 6) AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(*) AS requests, round(avg(savings_percent), 6) AS avg_savings FROM e GROUP BY 1 ORDER BY cost DESC, user_id LIMIT 10")
def b04_top_users(spark: SparkSession, d: str) -> DataFrame:
    return fo.top_users(t.prompt_events(spark, d), 30, 10)


@query(f"WITH {_last(30)} SELECT provider, round(sum(cost_usd), 6) AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(*) AS requests, round(sum(cost_usd) / sum(input_tokens), 8) AS cost_per_token FROM e GROUP BY 1")
def b05_provider_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return fo.provider_efficiency(t.prompt_events(spark, d), 30)


_SPIKES = f"""d AS (SELECT {DAY} AS day, sum(cost_usd) AS cost FROM e30 GROUP BY 1), s AS (SELECT avg(cost) AS m, stddev_pop(cost) AS sd, count(*) AS n FROM d)"""


@query(f"WITH {_last(30).replace('e AS', 'e30 AS', 1)}, {_SPIKES} SELECT day, round(cost, 6) AS cost_usd, round((cost - m) / sd, 2) AS z_score, 'cost_spike' AS type, CASE WHEN (cost - m) / sd >= 3.5 THEN 'critical' ELSE 'warning' END AS severity FROM d, s WHERE n >= 5 AND sd > 0 AND (cost - m) / sd >= 1.2")
def b07_daily_spikes(spark: SparkSession, d: str) -> DataFrame:
    return fo.daily_spikes(t.prompt_events(spark, d), z=1.2)


_DRIFT = "u AS (SELECT user_id, sum(cost_usd) AS cost, count(*) AS requests FROM e7 GROUP BY 1), md AS (SELECT median(cost) AS m, count(*) AS n FROM u)"


@query(f"WITH {_last(7).replace('e AS', 'e7 AS', 1)}, {_DRIFT} SELECT user_id, round(cost, 6) AS cost_usd, requests, 'user_drift' AS type, round(cost / m, 1) AS ratio_vs_median FROM u, md WHERE n >= 2 AND m > 0 AND cost > m * CAST(1.5 AS DOUBLE)")
def b08_user_drift(spark: SparkSession, d: str) -> DataFrame:
    return fo.user_drift(t.prompt_events(spark, d), times=1.5)


@query(
    f"WITH {_last(30).replace('e AS', 'e30 AS', 1)}, {_last(7).replace('e AS', 'e7 AS', 1)}, {_SPIKES}, {_DRIFT} "
    "SELECT day, round(cost, 6) AS cost_usd, round((cost - m) / sd, 2) AS z_score, 'cost_spike' AS type, CASE WHEN (cost - m) / sd >= 3.5 THEN 'critical' ELSE 'warning' END AS severity, NULL AS user_id, NULL AS requests, CAST(NULL AS DOUBLE) AS ratio_vs_median FROM d, s WHERE n >= 5 AND sd > 0 AND (cost - m) / sd >= 1.2 "
    "UNION ALL SELECT NULL, round(cost, 6), NULL, 'user_drift', NULL, user_id, requests, round(cost / m, 1) FROM u, md WHERE n >= 2 AND m > 0 AND cost > m * CAST(1.5 AS DOUBLE)"
)
def b09_anomaly_scan(spark: SparkSession, d: str) -> DataFrame:
    return fo.anomaly_scan(t.prompt_events(spark, d), 1.2, 1.5)


def _forecast_sql(name: str, days: int) -> str:
    return f"""SELECT '{name}' AS horizon, round(a * {days} * (1 + tr * CAST(0.5 AS DOUBLE)), 2) AS projected_usd, round(a, 4) AS daily_avg_usd, round(tr * 100, 1) AS trend_percent,
  CASE WHEN n >= 14 THEN 'high' WHEN n >= 7 THEN 'medium' ELSE 'low' END AS confidence, n AS data_points FROM (
  SELECT *, CASE WHEN n >= 7 AND older <> 0 THEN (recent - older) / older ELSE 0 END AS tr FROM (
  SELECT avg(cost) AS a, count(*) AS n, avg(cost) FILTER (up > c - 7) AS recent, avg(cost) FILTER (up <= 7) AS older FROM (
  SELECT cost, row_number() OVER (ORDER BY day) AS up, count(*) OVER () AS c FROM (SELECT {DAY} AS day, sum(cost_usd) AS cost FROM ({E}) x
  WHERE created_at >= (SELECT max(ts) FROM events WHERE value IS NOT NULL) - INTERVAL {min(days, 90)} DAYS GROUP BY 1))))"""


HORIZONS = {"monthly": 30, "quarterly": 90, "annual": 365}


@query(_forecast_sql("monthly", 30))
def b10_forecast(spark: SparkSession, d: str) -> DataFrame:
    return fo.forecast(t.prompt_events(spark, d), "monthly", 30)


@query(" UNION ALL ".join(_forecast_sql(*x) for x in HORIZONS.items()))
def b11_forecast_all(spark: SparkSession, d: str) -> DataFrame:
    e = t.prompt_events(spark, d)
    one, two, three = (fo.forecast(e, *x) for x in HORIZONS.items())
    return one.unionByName(two).unionByName(three)


_ROI = f"""WITH {_last(30)}, s AS (SELECT sum(cost_usd) AS actual, sum(CASE WHEN compressed = 1 THEN cost_usd / (1 - CASE WHEN savings_percent >= 99 THEN CAST(0.99 AS DOUBLE) ELSE savings_percent / 100 END) ELSE cost_usd END) AS before,
  sum(input_tokens) AS tokens, avg(CASE WHEN compressed = 1 THEN savings_percent ELSE 0 END) AS savings FROM e),
g AS (SELECT *, greatest(before - actual, 0) AS gross, tokens / CAST(1000 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS fee FROM s)
SELECT round(before, 2) AS baseline_cost_usd, round(actual, 2) AS optimized_cost_usd, round(gross, 2) AS gross_savings_usd, round(fee, 2) AS fee_usd, round(gross - fee, 2) AS net_roi_usd,
  round((gross - fee) / fee * 100, 1) AS roi_percent, CAST(tokens AS BIGINT) AS total_tokens, round(savings, 1) AS avg_savings_percent, CASE WHEN gross > fee THEN 'positive' ELSE 'neutral' END AS verdict FROM g"""


@query(_ROI)
def b12_roi(spark: SparkSession, d: str) -> DataFrame:
    return fo.roi(t.prompt_events(spark, d), 30)


@query(_ROI.replace("g AS (SELECT *,", "g AS (SELECT * REPLACE (actual / (1 - CAST(0.35 AS DOUBLE)) AS before),").replace("greatest(before - actual, 0)", "greatest(actual / (1 - CAST(0.35 AS DOUBLE)) - actual, 0)"))
def b12_roi_assumed_rate(spark: SparkSession, d: str) -> DataFrame:
    return fo.roi(t.prompt_events(spark, d), 30, assumed_rate=0.35)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def a04_upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return fo.latest_by(t.read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "customer").filter("c_acctbal > 0")
    budgets = c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("scope_id"), (F.col("c_acctbal") / 10000).alias("amount_usd"), F.lit(0.8).alias("alert_threshold"))
    spend = t.prompt_events(spark, d).groupBy(F.col("user_id").alias("scope_id")).agg(F.sum("cost_usd").alias("spent_usd"))
    return fo.budget_status(budgets, spend, 0.05)


_BUDGET = f"""SELECT scope_id, round(amount_usd, 6) AS amount_usd, round(spent, 6) AS spent_usd, spent + CAST(0.05 AS DOUBLE) <= amount_usd AS allowed, round(spent / amount_usd, 3) AS utilization, spent / amount_usd >= CAST(0.8 AS DOUBLE) AS alert
FROM (SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS scope_id, c_acctbal / 10000 AS amount_usd, coalesce(spent, 0) AS spent FROM customer
LEFT JOIN (SELECT user_id, sum(cost_usd) AS spent FROM ({E}) e GROUP BY 1) s ON s.user_id = concat('u', CAST(c_custkey AS VARCHAR)) WHERE c_acctbal > 0)"""


@query(_BUDGET)
def b14_budget_status(spark: SparkSession, d: str) -> DataFrame:
    return _budgets(spark, d)


@query(f"SELECT * FROM ({_BUDGET}) b WHERE alert")
def b16_budget_alerts(spark: SparkSession, d: str) -> DataFrame:
    return fo.budget_alerts(_budgets(spark, d))


_INVENTORY = f"SELECT prompt_key, count(*) AS uses, round(sum(cost_usd), 6) AS cost, round(avg(savings_percent), 6) AS avg_savings, CAST(sum(input_tokens) AS BIGINT) AS tokens, max(model) AS model FROM ({E}) e GROUP BY 1"


@query(_INVENTORY)
def b17_prompt_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inv.prompt_inventory(t.prompt_events(spark, d))


@query(f"WITH i AS ({_INVENTORY}) " + " UNION ALL ".join(f"SELECT '{k}' AS list, prompt_key, row_number() OVER (ORDER BY {c} DESC, prompt_key) AS rank FROM i QUALIFY rank <= 10" for k, c in (("most_used", "uses"), ("most_expensive", "cost"), ("most_compressible", "avg_savings"))))
def b18_top_prompts(spark: SparkSession, d: str) -> DataFrame:
    return inv.top_prompts(inv.prompt_inventory(t.prompt_events(spark, d)), 10)


@query(f"SELECT count(DISTINCT prompt_key) AS unique_prompts, count(*) AS uses, round(sum(cost_usd), 6) AS cost, round(avg(savings_percent), 6) AS avg_savings FROM ({E}) e")
def b19_inventory_stats(spark: SparkSession, d: str) -> DataFrame:
    return inv.inventory_stats(t.prompt_events(spark, d))


Q = "(quality_sum / nullif(n_samples, 0))"


@query(f"SELECT count(*) AS total, CAST(sum(CASE WHEN {Q} >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN {Q} < 0.3 AND n_samples > 0 THEN 1 ELSE 0 END) AS BIGINT) AS poor, round(avg({Q}), 6) AS avg_quality, round(avg(rate), 6) AS avg_rate FROM ({C}) c")
def b20_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return de.quality_summary(t.cells(spark, d))


PROFILE = t.sql_case(t.PROFILE_OF_RATE, "rate")
_BY_PROFILE = f"SELECT rate, round(avg({Q}), 6) AS avg_quality, count(*) AS n, CASE " + " ".join(f"WHEN rate = CAST({k} AS DOUBLE) THEN '{v}'" for k, v in t.PROFILE_OF_RATE.items()) + f" END AS profile FROM ({C}) c GROUP BY rate"


@query(_BY_PROFILE)
def b21_quality_by_profile(spark: SparkSession, d: str) -> DataFrame:
    return de.quality_by_profile(t.cells(spark, d))


_BY_TASK = f"SELECT task_type, round(avg({Q}), 6) AS avg_quality, round(avg(rate), 6) AS avg_rate, count(*) AS n, round(sum(CASE WHEN {Q} >= 0.7 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 3) AS good_ratio FROM ({C}) c GROUP BY 1"


@query(_BY_TASK)
def b22_quality_by_task(spark: SparkSession, d: str) -> DataFrame:
    return de.quality_by_task(t.cells(spark, d))


@query(f"SELECT CAST(sum(tokens_original - tokens_compressed) AS BIGINT) AS tokens_saved, count(*) AS requests, round(avg(savings_percent), 2) AS avg_savings, round(sum(tokens_original - tokens_compressed) * CAST(0.000005 AS DOUBLE) * CAST(0.2 AS DOUBLE), 2) AS saved_usd FROM ({R}) r")
def b23_savings_estimate(spark: SparkSession, d: str) -> DataFrame:
    return de.savings_estimate(t.requests(spark, d))


@query(f"SELECT * FROM ({_BY_PROFILE}) p WHERE avg_quality < 0.72")
def b24_low_quality_alerts(spark: SparkSession, d: str) -> DataFrame:
    return de.low_quality_alerts(t.cells(spark, d), 0.72)


@query(f"SELECT round(avg(CASE WHEN rate = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS bypass_ratio, avg(CASE WHEN rate = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) > 0.5 AS alert FROM ({R}) r")
def b25_bypass_share(spark: SparkSession, d: str) -> DataFrame:
    return de.bypass_share(t.requests(spark, d))


@query(f"SELECT * FROM ({_BY_TASK}) p WHERE avg_quality < 0.775 AND n >= 3")
def b26_degraded_tasks(spark: SparkSession, d: str) -> DataFrame:
    return de.degraded_tasks(t.cells(spark, d), 0.775)


@query(f"SELECT concat_ws('|', tenant_id, CAST(user_cluster AS VARCHAR), task_type, length_bucket, model) AS cell, rate, round({Q}, 4) AS quality, n_samples FROM ({C}) c WHERE n_samples >= 3")
def b28_cell_listing(spark: SparkSession, d: str) -> DataFrame:
    return de.cell_listing(t.cells(spark, d), 3)


_DEFAULTS = f"SELECT tenant_id, rate, round(CASE WHEN rate = 0 THEN 1 ELSE coalesce(avg(CASE WHEN n_samples > 5 THEN {Q} END), CAST(0.85 AS DOUBLE)) END, 6) AS default_quality FROM ({C}) c GROUP BY 1, 2"


@query(_DEFAULTS)
def b29_default_quality(spark: SparkSession, d: str) -> DataFrame:
    return de.default_quality(t.cells(spark, d))


@query(f"WITH {_last(30)} SELECT coalesce(provider, 'all') AS provider, coalesce(model, 'all') AS model, round(sum(cost_usd), 6) AS cost, count(*) AS requests, CAST(grouping_id(provider, model) AS BIGINT) AS level FROM e GROUP BY ROLLUP (provider, model)")
def b30_executive_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return fo.executive_breakdown(t.prompt_events(spark, d), 30)


@query(f"WITH {_last(7).replace('e AS', 'a AS', 1)}, {_last(14).replace('e AS', 'b AS', 1)}, x AS (SELECT sum(cost_usd) AS now FROM a), y AS (SELECT sum(cost_usd) AS w FROM b) SELECT round(now, 6) AS current_cost, round(w - now, 6) AS previous_cost FROM x, y")
def b30_period_change(spark: SparkSession, d: str) -> DataFrame:
    return fo.period_change(t.prompt_events(spark, d), 7)


@query(f"WITH {_last(7)} SELECT {DAY} AS day, count(*) AS n, round(avg(savings_percent), 1) AS avg_savings, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM e GROUP BY 1")
def b31_history_stats(spark: SparkSession, d: str) -> DataFrame:
    return inv.history_stats(t.prompt_events(spark, d), 7)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("term"), F.col("p_type").alias("definition"), F.when(F.col("p_size") > 25, 1).otherwise(0).alias("validated"))


@query("SELECT p_brand AS category, p_name AS term, p_type AS definition FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') ORDER BY 1, 2")
def b32_knowledge_search(spark: SparkSession, d: str) -> DataFrame:
    return inv.knowledge_search(_terms(spark, d), "AN")


@query("SELECT p_brand AS category, count(*) AS terms, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS validated FROM part GROUP BY 1")
def b33_knowledge_summary(spark: SparkSession, d: str) -> DataFrame:
    return inv.knowledge_summary(_terms(spark, d))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return e.select("user_id", "key", F.col("last").cast("string").alias("value"), (F.col("n") / 100.0).alias("confidence"))


_PROFILES = "SELECT user_id, event_type AS key, CAST(max(event_id) AS VARCHAR) AS value, count(*) / CAST(100 AS DOUBLE) AS confidence FROM events GROUP BY 1, 2"


@query(f"SELECT user_id, string_agg(key || '=' || value, ';' ORDER BY key) AS profile, count(*) AS n_keys FROM ({_PROFILES}) p GROUP BY 1")
def b34_profile_map(spark: SparkSession, d: str) -> DataFrame:
    return inv.profile_map(_profiles(spark, d))


@query(f"SELECT * FROM ({_PROFILES}) p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, key) <= 2")
def b35_compact_profile(spark: SparkSession, d: str) -> DataFrame:
    return inv.compact_profile(_profiles(spark, d), 2)


_MATRIX = f"SELECT task_type, length_bucket, model, " + ", ".join(f"round(coalesce(avg(CASE WHEN rate = CAST({x} AS DOUBLE) THEN {Q} END), CAST(0.5 AS DOUBLE)), 6) AS rate_{int(round(x * 100)):02d}" for x in t.RATES) + f" FROM ({C}) c WHERE n_samples > 3 GROUP BY 1, 2, 3"


@query(_MATRIX)
def b39_rate_matrix(spark: SparkSession, d: str) -> DataFrame:
    return de.rate_matrix(t.cells(spark, d))


_V = "[" + ", ".join(f"rate_{int(round(x * 100)):02d}" for x in t.RATES) + "]"


@query(f"""WITH m AS (SELECT concat_ws('|', task_type, length_bucket, model) AS context, {_V} AS v FROM ({_MATRIX}) x)
SELECT a.context, b.context AS other, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + CAST(1e-9 AS DOUBLE)), 9) AS cosine,
  row_number() OVER (PARTITION BY a.context ORDER BY round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + CAST(1e-9 AS DOUBLE)), 9) DESC, b.context) AS rank
FROM m a JOIN m b ON a.context <> b.context QUALIFY rank <= 5""")
def i20_context_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return de.context_neighbours(de.rate_matrix(t.cells(spark, d)))


@query(f"SELECT e.prompt_key, p.model, round(tokens / CAST(1000 AS DOUBLE) * in_price + tokens / CAST(1000 AS DOUBLE) * out_price, 8) AS cost_usd FROM (SELECT prompt_key, sum(input_tokens) AS tokens FROM ({E}) x GROUP BY 1) e, ({t.PRICES_SQL}) p")
def b40_cost_simulation(spark: SparkSession, d: str) -> DataFrame:
    prompts = t.prompt_events(spark, d).groupBy("prompt_key").agg(F.sum("input_tokens").alias("tokens"))
    return fo.cost_simulation(prompts, t.model_prices(spark))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return de.expected(t.cells(spark, d)).withColumn("token_count", 40 + F.col("user_cluster") * 400)


_CTX = ", ".join(de.CONTEXT)
_num = lambda x: f"CAST({x} AS DOUBLE)"
_case = lambda v, key, other: f"CASE {key} " + " ".join(f"WHEN {repr(k) if isinstance(k, str) else _num(k)} THEN {_num(x)}" for k, x in v.items()) + f" ELSE {_num(other)} END"
_STATES = f"""SELECT *, CASE WHEN n_samples < 2 THEN CAST(1 AS DOUBLE) ELSE greatest(expected_quality * (1 - expected_quality), 0) / n_samples END AS variance, 40 + user_cluster * 400 AS token_count FROM (
SELECT k.*, r.rate, coalesce(quality_sum, 0) AS quality_sum, coalesce(n_samples, 0) AS n_samples,
  CASE WHEN coalesce(n_samples, 0) < 1 THEN coalesce(default_quality, {_num(0.85)}) ELSE quality_sum / n_samples END AS expected_quality
FROM (SELECT DISTINCT {_CTX} FROM ({C}) c) k CROSS JOIN (SELECT unnest([{', '.join(_num(x) for x in t.RATES)}]) AS rate) r
LEFT JOIN ({C}) c ON {' AND '.join(f'c.{x} = k.{x}' for x in de.CONTEXT)} AND c.rate = r.rate LEFT JOIN ({_DEFAULTS}) df ON df.tenant_id = k.tenant_id AND df.rate = r.rate)"""
_UTILITY = f"""SELECT *, rate = 0 OR (utility > 0 AND q >= {_num(0.8)} AND token_count * rate * price * (1 - {_num(0.2)}) >= least) AS valid FROM (
SELECT *, CASE WHEN rate = 0 THEN 0 ELSE token_count * rate * price * {_num(0.2)} - {_case(de.COMPUTE_COST, 'rate', 0)} - (1 - q) * {_case(de.FAILURE_COST, 'task_type', de.OTHER_FAILURE_COST)} END AS utility FROM (
SELECT *, CASE WHEN n_samples >= 5 THEN expected_quality ELSE {_num(0.85)} END AS q, {_case(de.TOKEN_PRICE, 'model', de.OTHER_PRICE)} AS price, {_case(de.LEAST_SAVING, 'model', de.OTHER_SAVING)} AS least FROM ({_STATES}) s))"""


@query(f"SELECT {_CTX}, rate, n_samples, round(expected_quality, 6) AS expected_quality, round(variance, 6) AS variance FROM ({_STATES}) s")
def c02_i01_expected_quality(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select(*de.CONTEXT, "rate", "n_samples", F.round("expected_quality", 6).alias("expected_quality"), F.round("variance", 6).alias("variance"))


@query(f"SELECT {_CTX}, rate, round(utility, 8) AS utility, valid FROM ({_UTILITY}) u")
def i03_utility(spark: SparkSession, d: str) -> DataFrame:
    return de.with_utility(_states(spark, d)).select(*de.CONTEXT, "rate", F.round("utility", 8).alias("utility"), "valid")


@query(f"""SELECT {_CTX}, rate, CASE {' '.join(f"WHEN rate = {_num(k)} THEN '{v}'" for k, v in t.PROFILE_OF_RATE.items())} END AS profile FROM (
SELECT {_CTX}, coalesce(first(rate ORDER BY ucb DESC, rate) FILTER (valid AND rate <= {_num(0.55)} AND token_count >= 50), 0) AS rate FROM (
SELECT *, CASE WHEN n_samples < 1 THEN CAST('inf' AS DOUBLE) ELSE expected_quality + {_num(1.5)} * sqrt(variance) / greatest(n_samples, 1) END AS ucb FROM ({_UTILITY}) u) GROUP BY {_CTX})""")
def i05_decide(spark: SparkSession, d: str) -> DataFrame:
    return de.decide(_states(spark, d), cap=0.55)


@query(f"""WITH s AS (SELECT sum(tokens_original) AS tokens, count(*) AS n FROM ({R}) q), p AS (SELECT rate, CAST(floor(tokens * rate) AS BIGINT) AS tokens_saved, n FROM s, (SELECT unnest([{', '.join(_num(x) for x in t.RATES if 0 < x <= 0.55)}]) AS rate)),
g AS (SELECT *, tokens_saved * {_num(5e-6)} AS gross, tokens_saved * {_num(5e-6)} * {_num(0.2)} + n * {_case(de.COMPUTE_COST, 'rate', 0)} AS fee FROM p)
SELECT rate, tokens_saved, round(gross, 6) AS gross, round(fee, 6) AS fee, round(gross - fee, 6) AS net, round((gross - fee) * 12, 6) AS annual_net, gross - fee = max(gross - fee) OVER () AS best FROM g""")
def i09_onboarding_roi(spark: SparkSession, d: str) -> DataFrame:
    return de.onboarding_roi(t.requests(spark, d), 0.55)


@query(C)
def i14_cell_update(spark: SparkSession, d: str) -> DataFrame:
    return de.contributions(t.requests(spark, d))


_X = ["event_id % 7", "event_id % 11", "floor(value / 50)"]


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY value, event_id) AS up, row_number() OVER (ORDER BY value DESC, event_id DESC) AS down FROM events WHERE value IS NOT NULL),
x AS (SELECT event_id AS i, [{', '.join(f'CAST({f} AS DOUBLE)' for f in _X)}] AS v FROM o WHERE up <= 100), y AS (SELECT event_id AS i, [{', '.join(f'CAST({f} AS DOUBLE)' for f in _X)}] AS v FROM o WHERE down <= 100),
xx AS (SELECT avg(exp(-((list_distance(a.v, b.v) ** 2) / 2))) AS k FROM x a, x b WHERE a.i <> b.i), yy AS (SELECT avg(exp(-((list_distance(a.v, b.v) ** 2) / 2))) AS k FROM y a, y b WHERE a.i <> b.i), xy AS (SELECT avg(exp(-((list_distance(a.v, b.v) ** 2) / 2))) AS k FROM x a, y b)
SELECT round(greatest(xx.k + yy.k - 2 * xy.k, 0), 6) AS mmd, greatest(xx.k + yy.k - 2 * xy.k, 0) > {_num(0.05)} AS drift FROM xx, yy, xy""")
def i21_drift(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events").filter("value IS NOT NULL").selectExpr("event_id", "value", *[f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(_X)])
    names = [f"f{i}" for i in range(len(_X))]
    return de.mean_discrepancy(e.orderBy("value", "event_id").limit(100), e.orderBy(F.desc("value"), F.desc("event_id")).limit(100), names)


POLICIES = [("no_mini", "deny_model", "gpt-4o-mini", 0, 1), ("only_openai", "limit_provider", "openai", 0, 0), ("small", "max_tokens", "", 4000, 1), ("squeeze", "force_compression", "", 0, 1)]


def _policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "name string, rule_type string, subject string, amount long, enabled int")


@query(f"""SELECT id, coalesce(bool_and(NOT deny), true) AS allowed, coalesce(string_agg(name, ',' ORDER BY name), '') AS policies, coalesce(bool_or(rule_type = 'force_compression'), false) AS force_compression FROM (
SELECT e.id, p.name, p.rule_type, (rule_type = 'deny_model' AND model = subject) OR (rule_type = 'limit_provider' AND provider <> subject) OR (rule_type = 'max_tokens' AND input_tokens > amount) AS deny
FROM ({E}) e LEFT JOIN (SELECT * FROM (VALUES {', '.join(map(str, POLICIES))}) AS v(name, rule_type, subject, amount, enabled) WHERE enabled = 1) p
ON (rule_type = 'deny_model' AND model = subject) OR (rule_type = 'limit_provider' AND provider <> subject) OR (rule_type = 'max_tokens' AND input_tokens > amount) OR rule_type IN ('force_compression', 'force_cache')) GROUP BY id""")
def j06_policy_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return go.evaluate_policies(t.prompt_events(spark, d), _policies(spark))


REQUIREMENTS = [("gdpr", "eu_residency", "true"), ("gdpr", "retention", "30"), ("soc2", "audit_log", "true"), ("soc2", "mfa", "true"), ("hipaa", "encryption", "true")]
CONFIG = [("eu_residency", "true"), ("retention", "30"), ("audit_log", "true"), ("mfa", "false")]


@query(f"SELECT framework, bool_and(coalesce(value = wanted, false)) AS compliant, CAST(sum(CASE WHEN coalesce(value = wanted, false) THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM (VALUES {', '.join(map(str, REQUIREMENTS))}) AS r(framework, setting, wanted) LEFT JOIN (VALUES {', '.join(map(str, CONFIG))}) AS c(setting, value) USING (setting) GROUP BY 1")
def j08_compliance(spark: SparkSession, d: str) -> DataFrame:
    return go.compliance(spark.createDataFrame(CONFIG, "setting string, value string"), spark.createDataFrame(REQUIREMENTS, "framework string, setting string, wanted string"))


@query("SELECT user_id AS item, max_by(event_type, event_id) AS status, count(*) AS changes FROM events GROUP BY 1")
def j09_approval_state(spark: SparkSession, d: str) -> DataFrame:
    log = t.read(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("status"), "event_id")
    return go.latest_status(log, "item", "event_id", ["status"])


@query(f"SELECT id, CASE WHEN model = 'deepseek-chat' THEN 'deny' WHEN id % 4 = 0 THEN 'cache_hit' WHEN input_tokens > 2000 THEN 'compress_industrial' WHEN input_tokens > 200 OR id % 10 = 0 THEN 'compress_balanced' WHEN output_tokens < 50 THEN 'bypass' ELSE 'compress' END AS route FROM ({E}) e")
def j10_route(spark: SparkSession, d: str) -> DataFrame:
    e, c = t.prompt_events(spark, d), F.col
    return e.select("id", go.route(c("model") == "deepseek-chat", c("id") % 4 == 0, c("input_tokens"), c("output_tokens"), c("id") % 10 == 0).alias("route"))


@query("SELECT cache_key, count(*) AS uses, max(n) AS chars, max(n) >= 30 AND (count(*) >= 2 OR max(n) > 500) AS use_cache FROM (SELECT substr(sha256(concat_ws(':', source, substr(text, 1, 500))), 1, 16) AS cache_key, length(text) AS n FROM documents) GROUP BY 1")
def j11_cache_frequency(spark: SparkSession, d: str) -> DataFrame:
    return go.cache_frequency(t.read(spark, d, "documents").select(F.col("source").alias("model"), "text"))


_VARIANT = "CASE WHEN CAST(concat('0x', substr(sha256(concat('exp1:', user_id)), 1, 8)) AS BIGINT) % 100 < 50 THEN 'A' ELSE 'B' END"


@query(f"SELECT user_id, {_VARIANT} AS variant FROM (SELECT DISTINCT user_id FROM ({E}) e)")
def j14_variant_assignment(spark: SparkSession, d: str) -> DataFrame:
    return t.prompt_events(spark, d).select("user_id").distinct().withColumn("variant", go.variant("exp1", F.col("user_id")))


@query(f"""WITH b AS (SELECT {_VARIANT} AS variant, count(*) AS n, round(avg(cost_usd), 6) AS avg_cost, round(avg(savings_percent), 3) AS avg_quality, round(avg(input_tokens), 1) AS avg_tokens FROM ({E}) e GROUP BY 1)
SELECT *, CASE WHEN count(*) OVER () = 2 THEN first_value(variant) OVER (ORDER BY avg_cost, variant DESC) END AS winner FROM b""")
def j15_experiment_results(spark: SparkSession, d: str) -> DataFrame:
    return go.experiment_results(t.prompt_events(spark, d), "exp1")


def _service(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("endpoint"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("ts").alias("at"))


_METRICS = "SELECT event_type AS endpoint, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(value), 6) AS avg_ms, round(max(value), 6) AS max_ms FROM events GROUP BY 1"


@query(_METRICS)
def j16_request_metrics(spark: SparkSession, d: str) -> DataFrame:
    return go.request_metrics(_service(spark, d))


@query("SELECT endpoint, round(sum(value * (1 - CAST(0.9 AS DOUBLE)) * pow(CAST(0.9 AS DOUBLE), back)), 4) AS ema_ms FROM (SELECT event_type AS endpoint, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events) GROUP BY 1")
def j16_latency_ema(spark: SparkSession, d: str) -> DataFrame:
    return go.latency_ema(_service(spark, d))


@query("SELECT event_type AS endpoint, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 100")
def k05_recent_traces(spark: SparkSession, d: str) -> DataFrame:
    return go.recent_traces(_service(spark, d), 100)


@query(f"SELECT count(*) AS requests, CAST(sum(tokens_original - tokens_compressed) AS BIGINT) AS tokens_saved, CAST(sum(CASE WHEN rate = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks, round(100 * sum(tokens_original - tokens_compressed) / CAST(sum(tokens_original) AS DOUBLE), 1) AS saved_percent, first(savings_percent ORDER BY created_at DESC, id DESC) AS last_savings FROM ({R}) r")
def j17_j18_compression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return go.compression_metrics(t.requests(spark, d))


@query(f"WITH m AS ({_METRICS}) SELECT concat('requests_total{{endpoint=\"', endpoint, '\"}} ', requests) AS line FROM m UNION ALL SELECT concat('errors_total{{endpoint=\"', endpoint, '\"}} ', errors) FROM m")
def a19_exposition(spark: SparkSession, d: str) -> DataFrame:
    return go.exposition(go.request_metrics(_service(spark, d)))


_W = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> ''))"


@query(f"""SELECT conv_id, turn, gap, round(sim, 6) AS similarity, CASE WHEN gap IS NULL THEN 'first' WHEN sim >= 0.65 AND gap <= 30 THEN 'reformulation' WHEN gap <= 60 THEN 'continuation' ELSE 'none' END AS signal FROM (
SELECT *, CASE WHEN len(list_distinct(list_concat(w, pw))) = 0 THEN 0 ELSE len(list_intersect(w, pw)) / CAST(len(list_distinct(list_concat(w, pw))) AS DOUBLE) END AS sim FROM (
SELECT conv_id, turn, t_sec - lag(t_sec) OVER o AS gap, {_W} AS w, lag({_W}) OVER o AS pw FROM ({t.SESSIONS_SQL}) s WINDOW o AS (PARTITION BY conv_id ORDER BY t_sec)))""".replace("CASE WHEN len(list_distinct(list_concat(w, pw))) = 0", "CASE WHEN pw IS NULL THEN NULL WHEN len(list_distinct(list_concat(w, pw))) = 0"))
def i12_session_signals(spark: SparkSession, d: str) -> DataFrame:
    return se.session_signals(t.session_prompts(spark, d))

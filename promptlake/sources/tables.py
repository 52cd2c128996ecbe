"""Readers, and the canonical tables of prompt traffic as projections of the raw event, conversation and document tables.

Each projection comes twice: as a DataFrame function, and as the SQL of the same rows for comparison (``*_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import import_on_workers

# Model names by kind of event, and prices per 1,000 tokens (input, output).
MODEL_OF_EVENT = {"view": "gpt-4o", "click": "gpt-4o-mini", "signup": "mistral-large", "purchase": "gemini-2.5-pro", "error": "deepseek-chat"}
PRICES = {
    "gpt-4o": ("openai", 0.0025, 0.01),
    "gpt-4o-mini": ("openai", 0.00015, 0.0006),
    "gemini-2.5-pro": ("google", 0.00125, 0.005),
    "deepseek-chat": ("deepseek", 0.00027, 0.0011),
    "mistral-large": ("mistral", 0.002, 0.006),
}
TASK_OF_EVENT = {"view": "factuel", "click": "resume", "signup": "analytique", "purchase": "code", "error": "instruction"}
RATES = (0.0, 0.15, 0.25, 0.40, 0.55, 0.70)
PROFILE_OF_RATE = {0.0: "bypass", 0.15: "safe", 0.25: "light", 0.40: "balanced", 0.55: "aggressive", 0.70: "max"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(values: dict, key: Column) -> Column:
    """A CASE expression over a small dictionary of fixed values; null for other keys."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def sql_case(values: dict, key: str, kind: str | None = None) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if kind == "double" else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in values.items()) + " END"


def model_prices(spark: SparkSession) -> DataFrame:
    """The price list: model, provider, in_price, out_price per 1,000 tokens."""
    return spark.createDataFrame([(m, *v) for m, v in PRICES.items()], "model string, provider string, in_price double, out_price double")


PRICES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{p}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, (p, i, o) in PRICES.items()) + ") AS prices(model, provider, in_price, out_price)"


def prompt_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage before pricing: one row per event with a value."""
    e = read(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    n, kept = F.col("event_id"), F.col("event_id") % 5 < 3
    return e.select(
        n.alias("id"), F.lit("default").alias("tenant_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("p"), (n % 97).cast("string")).alias("prompt_key"), lookup(MODEL_OF_EVENT, F.col("event_type")).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), F.floor(F.col("value") * 3).cast("long").alias("output_tokens"),
        F.when(kept, 1).otherwise(0).alias("compressed"), F.when(kept, (10 + n % 50).cast("double")).otherwise(F.lit(0.0)).alias("savings_percent"),
        F.col("ts").alias("created_at"), "event_type", "value",
    )


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds provider and cost_usd; a model that the list lacks costs 0 at provider unknown. The list is a fixed, small table."""
    cost = F.coalesce(F.col("input_tokens") / 1000.0 * F.col("in_price") + F.col("output_tokens") / 1000.0 * F.col("out_price"), F.lit(0.0))
    joined = usage.join(F.broadcast(prices), "model", "left")
    return joined.withColumns({"provider": F.coalesce("provider", F.lit("unknown")), "cost_usd": cost}).drop("in_price", "out_price")


def prompt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(prompt_usage(spark, sf_dir), model_prices(spark))


PROMPT_EVENTS_SQL = f"""SELECT u.*, coalesce(p.provider, 'unknown') AS provider,
  coalesce(input_tokens / CAST(1000 AS DOUBLE) * in_price + output_tokens / CAST(1000 AS DOUBLE) * out_price, CAST(0 AS DOUBLE)) AS cost_usd
FROM (SELECT event_id AS id, 'default' AS tenant_id, concat('u', CAST(user_id AS VARCHAR)) AS user_id, concat('p', CAST(event_id % 97 AS VARCHAR)) AS prompt_key,
  {sql_case(MODEL_OF_EVENT, "event_type")} AS model, CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens,
  CASE WHEN event_id % 5 < 3 THEN 1 ELSE 0 END AS compressed, CASE WHEN event_id % 5 < 3 THEN CAST(10 + event_id % 50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS savings_percent,
  ts AS created_at, event_type, value FROM events WHERE value IS NOT NULL) u LEFT JOIN ({PRICES_SQL}) p USING (model)"""


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens < 50, "short").when(tokens < 500, "medium").when(tokens < 2000, "long").otherwise("very_long")


def sql_length_bucket(tokens: str) -> str:
    return f"CASE WHEN {tokens} < 50 THEN 'short' WHEN {tokens} < 500 THEN 'medium' WHEN {tokens} < 2000 THEN 'long' ELSE 'very_long' END"


_RATE_OF = dict(enumerate(RATES))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided requests: task, cell, rate and tokens before and after."""
    p = prompt_events(spark, sf_dir)
    rate = lookup({k: float(v) for k, v in _RATE_OF.items()}, F.col("id") % 6)
    out = p.withColumns({
        "task_type": lookup(TASK_OF_EVENT, F.col("event_type")), "rate": rate, "tokens_original": F.col("input_tokens"),
        "user_cluster": F.substring("user_id", 2, 20).cast("long") % 20, "quality": 1 - (F.col("id") % 6) * 0.05 - (F.col("id") % 11) * 0.02,
    })
    return out.withColumns({"tokens_compressed": F.floor(F.col("tokens_original") * (1 - F.col("rate"))).cast("long"), "length_bucket": length_bucket(F.col("tokens_original"))})


REQUESTS_SQL = f"""SELECT r.*, CAST(floor(tokens_original * (1 - rate)) AS BIGINT) AS tokens_compressed, {sql_length_bucket("tokens_original")} AS length_bucket
FROM (SELECT p.*, {sql_case(TASK_OF_EVENT, "event_type")} AS task_type, {sql_case({k: float(v) for k, v in _RATE_OF.items()}, "CAST(id % 6 AS DOUBLE)", "double")} AS rate,
  input_tokens AS tokens_original, CAST(substr(user_id, 2) AS BIGINT) % 20 AS user_cluster,
  1 - (id % 6) * CAST(0.05 AS DOUBLE) - (id % 11) * CAST(0.02 AS DOUBLE) AS quality FROM ({PROMPT_EVENTS_SQL}) p) r"""

CELL = ("tenant_id", "user_cluster", "task_type", "length_bucket", "model", "rate")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bandit cell states: sums of quality and counts by cell."""
    return requests(spark, sf_dir).groupBy(*CELL).agg(F.round(F.sum("quality"), 6).alias("quality_sum"), F.count("*").cast("double").alias("n_samples"))


CELLS_SQL = f"SELECT {', '.join(CELL)}, round(sum(quality), 6) AS quality_sum, CAST(count(*) AS DOUBLE) AS n_samples FROM ({REQUESTS_SQL}) q GROUP BY ALL"


def session_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with derived seconds within their session."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    gap = 5 + (F.col("conv_id") * 7 + F.col("turn") * 13) % 70
    return c.select("conv_id", "turn", "text", (F.col("conv_id") * 1000 + F.sum(gap).over(Window.partitionBy("conv_id").orderBy("turn"))).cast("long").alias("t_sec"))


SESSIONS_SQL = """SELECT conv_id, turn, text, CAST(conv_id * 1000 + sum(5 + (conv_id * 7 + turn * 13) % 70) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS t_sec
FROM conversations WHERE role = 'user'"""

# Phrases that carry the trigger words of the text rules, dealt to documents in turn.
PHRASES = (
    "Please note that the system must not log passwords because it is very important.",
    "In order to comply, users should never share credentials; however, admins may review them.",
    "Contact a.b@example.com or https://example.com/x by 2025-12-31 for 15 percent off.",
    "Could you actually explain the steps in detail, please? It is basically a large number of items!!",
    "You are an expert writer. Summarize the key points in a table. Thank you very much.",
)


def phrased_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and t: each whole text with one phrase appended, so that the rules find work."""
    d = read(spark, sf_dir, "documents")
    phrase = lookup(dict(enumerate(PHRASES)), F.col("doc_id") % len(PHRASES))
    return d.select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), phrase).alias("t"))


PHRASED_SQL = "SELECT doc_id, concat_ws(' ', coalesce(text, ''), CASE " + " ".join(f"WHEN doc_id % {len(PHRASES)} = {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END) AS t FROM documents"

"""Queries of learning, exploration, attribution, governance logs, budgets and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decision as de
from ..operators import finops as fo
from ..operators import learning as le
from ..operators import sessions as se
from ..sources import tables as t
from .analytics import _service, _states
from .registry import query

E, R, C = t.PROMPT_EVENTS_SQL, t.REQUESTS_SQL, t.CELLS_SQL


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1")
def a02_first_row(spark: SparkSession, d: str) -> DataFrame:
    return fo.first_row(t.read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 = 1 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey % 7 = 0")
def a03_applied_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table after deletes, updates and inserts from a change table."""
    n = t.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    changes = n.filter("key % 5 = 0").select("key", F.lit(None).cast("string").alias("name"), F.lit("delete").alias("op"))
    changes = changes.unionByName(n.filter("key % 3 = 1 and key % 5 <> 0").select("key", F.concat(F.upper("name"), F.lit("!")).alias("name"), F.lit("update").alias("op")))
    changes = changes.unionByName(n.filter("key % 7 = 0").select((F.col("key") + 100).alias("key"), "name", F.lit("insert").alias("op")))
    return fo.apply_changes(n, changes, "key")


_DIGEST = "CAST(concat('0x', substr(sha256(concat('{0}:', id)), 1, 8)) AS BIGINT)"


@query(f"SELECT id, {_DIGEST.format('user')} % 40 AS user_id, {_DIGEST.format('tokens')} % 4000 + 20 AS tokens, [0.0, 0.15, 0.25, 0.4, 0.55, 0.7][CAST({_DIGEST.format('rate')} % 6 AS BIGINT) + 1]::DOUBLE AS rate FROM range(2500) AS x(id)")
def a20_seeded_requests(spark: SparkSession, d: str) -> DataFrame:
    return fo.seeded_requests(spark, 2500)


_BUDGETS = "SELECT o_custkey AS scope, o_totalprice AS amount, o_orderkey AS k FROM orders"


@query(f"SELECT scope, max_by(amount, k) AS amount, CAST(0 AS DOUBLE) AS spent FROM ({_BUDGETS}) b GROUP BY 1")
def b13_set_budget(spark: SparkSession, d: str) -> DataFrame:
    """The budget last set for each scope; setting one starts anew from nothing spent."""
    o = t.read(spark, d, "orders")
    by = o.groupBy(F.col("o_custkey").alias("scope")).agg(F.max_by("o_totalprice", "o_orderkey").alias("amount"))
    return by.withColumn("spent", F.lit(0.0))


@query(f"SELECT (SELECT count(*) FROM ({C}) c) AS cells, count(*) AS requests, round(avg(savings_percent), 2) AS avg_savings, CAST(sum(CASE WHEN id % 20 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS explorations FROM ({R}) r")
def b27_engine_status(spark: SparkSession, d: str) -> DataFrame:
    r = t.requests(spark, d)
    out = r.agg(F.count("*").alias("requests"), F.round(F.avg("savings_percent"), 2).alias("avg_savings"), F.sum(F.when(F.col("id") % 20 == 0, 1).otherwise(0)).alias("explorations"))
    return out.join(t.cells(spark, d).agg(F.count("*").alias("cells")))  # two rows of totals


_LOG = "SELECT event_id AS id, user_id AS policy, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'disable' ELSE 'enable' END AS action, ts AS logged, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _policy_log(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events")
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "disable").otherwise("enable")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("policy"), action.alias("action"), F.col("ts").alias("at"), F.from_json("props", "k long")["k"].alias("k"))


@query(f"SELECT id, policy, action, k FROM ({_LOG}) x ORDER BY logged DESC, id DESC LIMIT 100")
def b36_audit_log(spark: SparkSession, d: str) -> DataFrame:
    """The latest hundred entries of the audit log, with their details read from JSON."""
    return _policy_log(spark, d).orderBy(F.desc("at"), F.desc("id")).limit(100).select("id", "policy", "action", "k")


@query(f"SELECT policy, max_by(action, id) <> 'disable' AS enabled, count(*) AS changes, CAST(sum(CASE WHEN action = 'create' THEN 1 ELSE 0 END) AS BIGINT) AS created FROM ({_LOG}) x GROUP BY 1")
def j07_policy_state(spark: SparkSession, d: str) -> DataFrame:
    """Policies as their log of creations and switches leaves them."""
    log = _policy_log(spark, d)
    return log.groupBy("policy").agg((F.max_by("action", "id") != "disable").alias("enabled"), F.count("*").alias("changes"), F.sum(F.when(F.col("action") == "create", 1).otherwise(0)).alias("created"))


@query(f"SELECT prompt_key AS experiment, max(created_at) AS last_at, count(*) AS results, round(avg(cost_usd), 6) AS avg_cost FROM ({E}) e GROUP BY 1 ORDER BY last_at DESC, experiment LIMIT 50")
def b37_experiments(spark: SparkSession, d: str) -> DataFrame:
    """The fifty experiments with the latest results."""
    by = t.prompt_events(spark, d).groupBy(F.col("prompt_key").alias("experiment")).agg(F.max("created_at").alias("last_at"), F.count("*").alias("results"), F.round(F.avg("cost_usd"), 6).alias("avg_cost"))
    return by.orderBy(F.desc("last_at"), "experiment").limit(50)


# signals of requests, derived from their ids
_SIGNALS = {"copy": "id % 4 = 1", "continuation": "id % 3 = 1", "reformulation": "id % 5 = 2", "thumbs_up": "id % 11 = 3", "task_success": "id % 13 = 4"}
_SIGNALLED = f"SELECT *, {', '.join(f'CASE WHEN {v} THEN 1 ELSE 0 END AS {k}' for k, v in _SIGNALS.items())} FROM ({R}) r"
_LABEL = "CASE WHEN task_success = 1 OR (copy = 1 AND continuation = 1) THEN 1.0 WHEN thumbs_up = 1 THEN 0.95 WHEN copy = 1 THEN 0.85 WHEN continuation = 1 AND reformulation = 0 THEN 0.75 WHEN reformulation = 1 THEN 0.2 ELSE 0.5 END"


def _signalled(spark: SparkSession, d: str) -> DataFrame:
    return t.requests(spark, d).withColumns({k: F.expr(f"CASE WHEN {v} THEN 1 ELSE 0 END") for k, v in _SIGNALS.items()})


def _label():
    return le.pseudo_label(*[F.col(c) for c in ("copy", "continuation", "reformulation", "thumbs_up", "task_success")])


def _training(spark: SparkSession, d: str) -> DataFrame:
    rows = _signalled(spark, d).filter(" or ".join(f"{k} = 1" for k in _SIGNALS))
    c = F.col
    special = t.lookup({0: "generic", 1: "domain_jargon", 2: "entity_rich"}, c("id") % 3)
    features = le.encoded(c("task_type"), special, c("length_bucket"), c("user_cluster"), c("model"), c("rate"), c("tokens_original"), {k: c(k) for k in _SIGNALS})
    return rows.select("id", features.alias("features"), _label().alias("label"))


@query(f"SELECT id, CAST({_LABEL} AS DOUBLE) AS label FROM ({_SIGNALLED}) s")
def i16_pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    return _signalled(spark, d).select("id", _label().alias("label"))


_PLACES = [
    *(f"CASE WHEN task_type = '{x}' THEN 1 ELSE 0 END" for x in le.TASK_TYPES), *(f"CASE WHEN id % 3 = {i} THEN 1 ELSE 0 END" for i in range(3)), *(f"CASE WHEN length_bucket = '{x}' THEN 1 ELSE 0 END" for x in le.LENGTHS),
    "user_cluster / CAST(20 AS DOUBLE)", "CAST(concat('0x', substr(sha256(model), 1, 8)) AS BIGINT) % 100 / CAST(100 AS DOUBLE)", "rate", "least(tokens_original / CAST(2000 AS DOUBLE), 1)", *_SIGNALS,
    "CASE WHEN copy = 1 AND continuation = 1 THEN 1 ELSE 0 END", "CASE WHEN reformulation = 1 AND copy = 0 THEN 1 ELSE 0 END",
]


@query(f"SELECT id, {len(_PLACES)} AS n, round({' + '.join(f'{i + 1} * CAST({p} AS DOUBLE)' for i, p in enumerate(_PLACES))}, 6) AS features, CAST({_LABEL} AS DOUBLE) AS label FROM ({_SIGNALLED}) s WHERE {' OR '.join(f'{k} = 1' for k in _SIGNALS)}")
def b38_i17_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features and labels of all requests with a signal."""
    rows = _training(spark, d)
    places = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.size("features").cast("long").alias("n"), F.round(places, 6).alias("features"), "label")


@query()
def i18_quality_model(spark: SparkSession, d: str) -> DataFrame:
    """Predicted quality of the requests whose ids are not learned from."""
    rows = _training(spark, d)
    model = le.quality_model(rows.filter("id % 4 <> 0"))
    return le.predicted(model, rows.filter("id % 4 = 0")).select("id", "label", F.round("quality", 4).alias("quality"))


@query()
def i19_context_embeddings(spark: SparkSession, d: str) -> DataFrame:
    context = F.concat_ws("|", *[F.col(c).cast("string") for c in de.CONTEXT])
    m = t.cells(spark, d).withColumn("context", context).groupBy("context").pivot("rate", list(t.RATES)).agg(F.first(F.col("quality_sum") / F.col("n_samples")))
    m = m.toDF("context", *le.RATE_COLUMNS)
    return le.context_embeddings(m, le.RATE_COLUMNS).select("context", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query()
def i22_permutation_p_value(spark: SparkSession, d: str) -> DataFrame:
    """The lowest against the highest hundred values."""
    e = t.read(spark, d, "events").filter("value IS NOT NULL").selectExpr("event_id", "value", "CAST(event_id % 7 AS DOUBLE) AS f0", "value / 100 AS f1")
    return le.permutation_p_value(e.orderBy("value", "event_id").limit(100), e.orderBy(F.desc("value"), F.desc("event_id")).limit(100), ["f0", "f1"])


@query()
def h22_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Three judges' scores of each request, made from its numbers."""
    r = t.requests(spark, d)
    scores = F.array(F.col("quality"), F.least(F.lit(1.0), F.col("quality") + (F.col("id") % 5) / 20.0), (F.col("id") % 10) / 10.0)
    weights, main = F.array(F.lit(0.85), F.lit(0.7), F.lit(0.7)), F.array(F.lit(True), F.lit(False), F.lit(False))
    return r.select("id", le.consensus(scores, weights, main).alias("c")).select("id", F.round("c.value", 6).alias("value"), F.col("c.rounds").cast("long").alias("rounds"), "c.settled")


@query()
def i06_i07_exploration(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d).withColumn("token_count", F.col("token_count") * 100_000)
    price = F.coalesce(t.lookup(de.TOKEN_PRICE, F.col("model")), F.lit(de.OTHER_PRICE))
    return le.exploration_arms(s, de.CONTEXT, price, de.SHARE, 0.0001, 0.01)


@query("SELECT o_orderkey, rate, round(tokens * rate * 5e-6::DOUBLE, 8) AS savings, round(tokens * rate * 5e-6::DOUBLE * 0.2::DOUBLE - cost - (1 - 0.9::DOUBLE) * 0.01::DOUBLE, 8) AS utility FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS tokens FROM orders), (VALUES " + ", ".join(f"({k}::DOUBLE, {v}::DOUBLE)" for k, v in de.COMPUTE_COST.items()) + ") AS r(rate, cost)")
def i08_explained_rates(spark: SparkSession, d: str) -> DataFrame:
    o = t.read(spark, d, "orders").select("o_orderkey", F.explode(de.explain_rates(F.floor("o_totalprice"), 5e-6, 0.9)).alias("x"))
    return o.select("o_orderkey", "x.rate", F.round("x.savings", 8).alias("savings"), F.round("x.utility", 8).alias("utility"))


_HARD = "least(CASE id % 3 WHEN 2 THEN 0.4::DOUBLE WHEN 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN task_type IN ('creatif', 'brainstorming', 'instruction') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length_bucket IN ('long', 'very_long') THEN 0.2::DOUBLE ELSE 0 END, 1)"
_RELIABLE = "CASE " + " ".join(f"WHEN contains(lower(model), '{n}') THEN {v}::DOUBLE" for n, v in le.MODEL_RELIABILITY) + " ELSE 0.85::DOUBLE END"
_SCORES = f"SELECT *, CASE WHEN rate >= 0.4::DOUBLE THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS s1, CASE WHEN hard > 0.6::DOUBLE THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END * (1 - reliable) AS s2, 0.15::DOUBLE AS s3, 0.2::DOUBLE * (least(hard, 0.5::DOUBLE) / 0.5::DOUBLE) AS s4 FROM (SELECT *, {_HARD} AS hard, {_RELIABLE} AS reliable FROM ({_SIGNALLED}) s) h"
_ATTRIBUTED = f"""SELECT id, CASE WHEN reformulation = 0 THEN 'user' WHEN s1 = m THEN 'compression' WHEN s2 = m THEN 'model' WHEN s3 = m THEN 'user' ELSE 'context' END AS cause,
CASE WHEN reformulation = 0 AND continuation = 1 THEN 0.4::DOUBLE WHEN reformulation = 0 THEN 0.3::DOUBLE ELSE m / (s1 + s2 + s3 + s4) END AS confidence FROM (SELECT *, greatest(s1, s2, s3, s4) AS m FROM ({_SCORES}) x) y"""


@query(f"SELECT id, cause, round(confidence, 6) AS confidence, (cause = 'compression' AND confidence > 0.5) OR NOT ((cause = 'model' AND confidence > 0.7) OR (cause = 'user' AND confidence > 0.6)) AS counts FROM ({_ATTRIBUTED}) a")
def i10_i11_attribution(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    special = t.lookup({0: "generic", 1: "domain_jargon", 2: "entity_rich"}, c("id") % 3)
    a = le.attribute(c("rate"), c("model"), special, c("task_type"), c("length_bucket"), c("reformulation") == 1, c("continuation") == 1)
    out = _signalled(spark, d).select("id", a.alias("a"))
    return out.select("id", "a.cause", F.round("a.confidence", 6).alias("confidence"), le.counts_for_quality(c("a")).alias("counts"))


@query("SELECT id, signal, round(CASE signal WHEN 'reformulation' THEN 0.6::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0, 1 - sim)) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0, 1 - gap / 30::DOUBLE)) WHEN 'continuation' THEN 0.4::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0, 1 - gap / 60::DOUBLE)) ELSE 0.1::DOUBLE END, 6) AS weight, CASE signal WHEN 'reformulation' THEN 0.2::DOUBLE WHEN 'continuation' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS proxy FROM (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'reformulation' WHEN 1 THEN 'continuation' ELSE 'none' END AS signal, (o_orderkey % 10) / 10::DOUBLE AS sim, o_orderkey % 80 AS gap FROM orders)")
def i13_signal_weights(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    signal = F.when(k % 3 == 0, "reformulation").when(k % 3 == 1, "continuation").otherwise("none")
    o = t.read(spark, d, "orders").select(k.alias("id"), signal.alias("signal"), ((k % 10) / 10.0).alias("sim"), (k % 80).alias("gap"))
    return o.select("id", "signal", F.round(le.signal_weight(F.col("signal"), F.col("sim"), F.col("gap")), 6).alias("weight"), se.signal_weight(F.col("signal")).alias("proxy"))


@query(f"SELECT id, tokens_original, tokens_compressed, round((1 - tokens_compressed / CAST(greatest(tokens_original, 1) AS DOUBLE)) * 100, 2) AS saved_percent, round(tokens_compressed / CAST(greatest(tokens_original, 1) AS DOUBLE), 4) AS ratio FROM ({R}) r")
def i15_request_records(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("tokens_compressed") / F.greatest("tokens_original", F.lit(1))
    return t.requests(spark, d).select("id", "tokens_original", "tokens_compressed", F.round((1 - share) * 100, 2).alias("saved_percent"), F.round(share, 4).alias("ratio"))


@query(f"SELECT user_id, count(*) AS requests, max_by(model, id) AS model, CAST(sum(tokens_original - tokens_compressed) AS BIGINT) AS saved FROM ({R}) r GROUP BY 1")
def i15_session_records(spark: SparkSession, d: str) -> DataFrame:
    saved = F.sum(F.col("tokens_original") - F.col("tokens_compressed"))
    return t.requests(spark, d).groupBy("user_id").agg(F.count("*").alias("requests"), F.max_by("model", "id").alias("model"), saved.alias("saved"))


@query()
def j01_hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item's length of vector and first number."""
    v = t.read(spark, d, "benchmark").select("item_id", le.hash_embedding(F.col("text")).alias("v"))
    return v.select("item_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.round(F.get("v", 0), 6).alias("first"))


@query("SELECT substr(sha256(concat_ws(':', source, substr(text, 1, 500))), 1, 16) AS cache_key, count(*) AS hits FROM documents GROUP BY 1 ORDER BY hits DESC, cache_key LIMIT 10")
def j12_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """The ten keys stored most often."""
    key = F.substring(F.sha2(F.concat_ws(":", "source", F.substring("text", 1, 500)), 256), 1, 16)
    return t.read(spark, d, "documents").groupBy(key.alias("cache_key")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "cache_key").limit(10)


@query()
def j13_k08_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a provider through its breaker: those of value above 150 fail."""
    e = _service(spark, d).filter("duration_ms IS NOT NULL")
    return le.breaker_log(e.select(F.col("endpoint").alias("provider"), F.unix_micros(F.to_timestamp_ltz(F.col("at").cast("string"))).cast("double").alias("us"), "id", (F.col("duration_ms") < 150).alias("ok")).withColumn("at", F.col("us") / 1e6))


@query(f"SELECT id, user_id, count(quality) OVER w AS n, round(CAST(sum(CAST(round(quality * 1e6) AS BIGINT)) OVER w AS DOUBLE) / count(quality) OVER w / 1e6, 6) AS mean FROM ({R}) r WINDOW w AS (PARTITION BY user_id ORDER BY id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def k03_recent_window(spark: SparkSession, d: str) -> DataFrame:
    return le.recent(t.requests(spark, d), "user_id", ["id"], "quality").select("id", "user_id", "n", "mean")


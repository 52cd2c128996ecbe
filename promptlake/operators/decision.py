"""The adaptive decision engine as DataFrame operators: cell quality, utility, the UCB cascade, reports and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import CELL, PROFILE_OF_RATE, RATES, lookup
from .finops import r

# Failure cost by task, least client saving and token price by model, compute cost by profile.
FAILURE_COST = {"factuel": 0.002, "resume": 0.003, "traduction": 0.005, "brainstorming": 0.005, "general": 0.008, "analytique": 0.008, "creatif": 0.010, "instruction": 0.015, "code": 0.025}
OTHER_FAILURE_COST = 0.008
LEAST_SAVING = {"gpt-4o": 0.0010, "gpt-4o-mini": 0.0003, "claude-3.5-sonnet": 0.0006, "claude-3-haiku": 0.00005, "gemini-1.5-pro": 0.00025, "gemini-1.5-flash": 0.000015, "gpt-4": 0.0020, "gpt-3.5-turbo": 0.0001}
TOKEN_PRICE = {"gpt-4o": 0.000005, "gpt-4o-mini": 0.0000015, "claude-3.5-sonnet": 0.000003, "claude-3-haiku": 0.00000025, "gemini-1.5-pro": 0.00000125, "gemini-1.5-flash": 0.000000075, "gpt-4": 0.00001, "gpt-3.5-turbo": 0.0000005}
COMPUTE_COST = {0.0: 0.0, 0.15: 0.000005, 0.25: 0.000010, 0.40: 0.000020, 0.55: 0.000035, 0.70: 0.000050}
SHARE, LEAST_QUALITY, COLD_QUALITY, EXPLORE = 0.20, 0.80, 0.85, 1.5
OTHER_PRICE, OTHER_SAVING = 0.000005, 0.001
CONTEXT = ("tenant_id", "user_cluster", "task_type", "length_bucket", "model")


def profile_name(rate: Column) -> Column:
    return lookup(PROFILE_OF_RATE, rate)


def quality_ratio() -> Column:
    return F.col("quality_sum") / F.nullif("n_samples", F.lit(0.0))


def quality_summary(cells: DataFrame) -> DataFrame:
    q = quality_ratio()
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return cells.agg(F.count("*").alias("total"), flag(q >= 0.7).alias("good"), flag((q < 0.3) & (F.col("n_samples") > 0)).alias("poor"), r(F.avg(q)).alias("avg_quality"), r(F.avg("rate")).alias("avg_rate"))


def quality_by_profile(cells: DataFrame) -> DataFrame:
    return cells.groupBy("rate").agg(r(F.avg(quality_ratio())).alias("avg_quality"), F.count("*").alias("n")).withColumn("profile", profile_name(F.col("rate")))


def quality_by_task(cells: DataFrame) -> DataFrame:
    q = quality_ratio()
    return cells.groupBy("task_type").agg(
        r(F.avg(q)).alias("avg_quality"), r(F.avg("rate")).alias("avg_rate"), F.count("*").alias("n"), F.round(F.sum(F.when(q >= 0.7, 1).otherwise(0)) / F.count("*"), 3).alias("good_ratio")
    )


def savings_estimate(requests: DataFrame, token_price: float = 5e-6) -> DataFrame:
    saved = F.sum(F.col("tokens_original") - F.col("tokens_compressed"))
    return requests.agg(saved.alias("tokens_saved"), F.count("*").alias("requests"), F.round(F.avg("savings_percent"), 2).alias("avg_savings"), F.round(saved * token_price * SHARE, 2).alias("saved_usd"))


def low_quality_alerts(cells: DataFrame, least: float = 0.5) -> DataFrame:
    return quality_by_profile(cells).filter(F.col("avg_quality") < least)


def bypass_share(requests: DataFrame, most: float = 0.5) -> DataFrame:
    share = F.avg(F.when(F.col("rate") == 0, 1.0).otherwise(0.0))
    return requests.agg(r(share).alias("bypass_ratio"), (share > most).alias("alert"))


def degraded_tasks(cells: DataFrame, least: float = 0.4, rows: int = 3) -> DataFrame:
    return quality_by_task(cells).filter((F.col("avg_quality") < least) & (F.col("n") >= rows))


def cell_listing(cells: DataFrame, samples: float) -> DataFrame:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in CONTEXT])
    return cells.filter(F.col("n_samples") >= samples).select(key.alias("cell"), "rate", F.round(quality_ratio(), 4).alias("quality"), "n_samples")


def default_quality(cells: DataFrame) -> DataFrame:
    """Mean quality by tenant and rate over cells with more than five samples; certain at rate 0."""
    by = cells.groupBy("tenant_id", "rate").agg(F.avg(F.when(F.col("n_samples") > 5, quality_ratio())).alias("q"))
    return by.select("tenant_id", "rate", r(F.when(F.col("rate") == 0, 1.0).otherwise(F.coalesce("q", F.lit(COLD_QUALITY)))).alias("default_quality"))


def all_rates(cells: DataFrame) -> DataFrame:
    """Every context with each of the rates; cells that lack rows have no samples."""
    contexts = cells.select(*CONTEXT).distinct().withColumn("rate", F.explode(F.array(*[F.lit(x) for x in RATES])))
    return contexts.join(cells, list(CELL), "left").fillna({"quality_sum": 0.0, "n_samples": 0.0})


def expected(cells: DataFrame) -> DataFrame:
    """expected_quality and variance of each cell: the tenant's default under one sample, variance 1 under two."""
    out = all_rates(cells).join(default_quality(cells), ["tenant_id", "rate"], "left")
    q = F.when(F.col("n_samples") < 1, F.coalesce("default_quality", F.lit(COLD_QUALITY))).otherwise(quality_ratio())
    out = out.withColumn("expected_quality", q)
    p = F.col("expected_quality")
    return out.withColumn("variance", F.when(F.col("n_samples") < 2, 1.0).otherwise(F.greatest(p * (1 - p), F.lit(0.0)) / F.col("n_samples"))).drop("default_quality")


def utility(tokens: Column) -> Column:
    """Value of compressing at the row's rate: the share of savings, less compute, less the risk of failure."""
    price = F.coalesce(lookup(TOKEN_PRICE, F.col("model")), F.lit(OTHER_PRICE))
    quality = F.when(F.col("n_samples") >= 5, F.col("expected_quality")).otherwise(COLD_QUALITY)
    failure = F.coalesce(lookup(FAILURE_COST, F.col("task_type")), F.lit(OTHER_FAILURE_COST))
    return F.when(F.col("rate") == 0, 0.0).otherwise(tokens * F.col("rate") * price * SHARE - lookup(COMPUTE_COST, F.col("rate")) - (1 - quality) * failure)


def valid(tokens: Column) -> Column:
    price = F.coalesce(lookup(TOKEN_PRICE, F.col("model")), F.lit(OTHER_PRICE))
    quality = F.when(F.col("n_samples") >= 5, F.col("expected_quality")).otherwise(COLD_QUALITY)
    least = F.coalesce(lookup(LEAST_SAVING, F.col("model")), F.lit(OTHER_SAVING))
    return (F.col("rate") == 0) | ((F.col("utility") > 0) & (quality >= LEAST_QUALITY) & (tokens * F.col("rate") * price * (1 - SHARE) >= least))


def with_utility(states: DataFrame) -> DataFrame:
    """states with token_count: adds utility and whether a choice of the row is valid."""
    return states.withColumn("utility", utility(F.col("token_count"))).withColumn("valid", valid(F.col("token_count")))


def decide(states: DataFrame, cap: float = 1.0) -> DataFrame:
    """The UCB cascade: of each context's rates up to the cap, by falling upper confidence bound, the first valid one; without
    one, or under 50 tokens, bypass. Cells without samples come first; ties go to the smaller rate."""
    ucb = F.when(F.col("n_samples") < 1, float("inf")).otherwise(F.col("expected_quality") + EXPLORE * F.sqrt("variance") / F.greatest("n_samples", F.lit(1.0)))
    order = F.struct((-ucb).alias("ucb"), "rate")
    usable = F.col("valid") & (F.col("rate") <= cap) & (F.col("token_count") >= 50)
    chosen = with_utility(states).groupBy(*CONTEXT).agg(F.min_by("rate", F.when(usable, order)).alias("rate"))
    return chosen.select(*CONTEXT, F.coalesce("rate", F.lit(0.0)).alias("rate")).withColumn("profile", profile_name(F.col("rate")))


def explain_rates(tokens: Column, price: float, quality: float, risk: float = 0.01) -> Column:
    """Savings, cost and utility of every rate as an array."""
    rows = [F.struct(F.lit(x).alias("rate"), (tokens * x * price).alias("savings"), F.lit(COMPUTE_COST[x]).alias("cost"), (tokens * x * price * SHARE - COMPUTE_COST[x] - (1 - quality) * risk).alias("utility")) for x in RATES]
    return F.array(*rows)


def onboarding_roi(requests: DataFrame, cap: float, price: float = 5e-6) -> DataFrame:
    """For each rate up to the cap what a month and a year of the requests would save, and which rate is best."""
    t = requests.agg(F.sum("tokens_original").alias("tokens"), F.count("*").alias("n"))
    per = t.withColumn("rate", F.explode(F.array(*[F.lit(x) for x in RATES if 0 < x <= cap])))
    saved = F.floor(F.col("tokens") * F.col("rate")).cast("long")
    per = per.withColumn("tokens_saved", saved).withColumn("gross", F.col("tokens_saved") * price)
    per = per.withColumn("fee", F.col("gross") * SHARE + F.col("n") * lookup(COMPUTE_COST, F.col("rate"))).withColumn("net", F.col("gross") - F.col("fee"))
    best = F.max("net").over(Window.partitionBy())
    return per.select("rate", "tokens_saved", r(F.col("gross")).alias("gross"), r(F.col("fee")).alias("fee"), r(F.col("net")).alias("net"), r(F.col("net") * 12).alias("annual_net"), (F.col("net") == best).alias("best"))


def contributions(requests: DataFrame) -> DataFrame:
    """Cell updates as sums: each request adds its weighted quality and its weight, in any order."""
    return requests.groupBy(*CELL).agg(r(F.sum("quality")).alias("quality_sum"), F.count("*").cast("double").alias("n_samples"))


def rate_matrix(cells: DataFrame, samples: float = 3) -> DataFrame:
    """Contexts by rates: mean quality of cells with more samples, .5 where there is none."""
    names = {f"rate_{int(round(x * 100)):02d}": x for x in RATES}
    q = lambda x: F.avg(F.when(F.col("rate") == x, quality_ratio()))
    by = cells.filter(F.col("n_samples") > samples).groupBy("task_type", "length_bucket", "model").agg(*[r(F.coalesce(q(x), F.lit(0.5))).alias(n) for n, x in names.items()])
    return by


def context_neighbours(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The k contexts most alike by cosine of their rate vectors. Contexts are tasks by lengths by models: a bounded table."""
    columns = [c for c in matrix.columns if c.startswith("rate_")]
    m = matrix.select(F.concat_ws("|", "task_type", "length_bucket", "model").alias("context"), F.array(*columns).alias("v"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    m = m.withColumn("norm", norm(F.col("v")))
    other = F.broadcast(m.select(F.col("context").alias("other"), F.col("v").alias("w"), F.col("norm").alias("norm_w")))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = m.join(other, m["context"] != other["other"]).withColumn("cosine", F.round(dot / (F.col("norm") * F.col("norm_w") + 1e-9), 9))
    w = Window.partitionBy("context").orderBy(F.desc("cosine"), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("context", "other", "cosine", F.col("rank").cast("long").alias("rank"))


def mean_discrepancy(a: DataFrame, b: DataFrame, features: list[str], sigma: float = 1.0, threshold: float = 0.05) -> DataFrame:
    """Unbiased squared maximum mean discrepancy of two bounded windows (of a hundred rows each, say) under a Gaussian kernel."""
    vec = lambda d: d.select(F.monotonically_increasing_id().alias("i"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))

    def kernel_sum(x: DataFrame, y: DataFrame, same: bool, name: str) -> DataFrame:
        y = y.select(F.col("i").alias("j"), F.col("v").alias("w"))
        d2 = F.aggregate(F.zip_with("v", "w", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)
        pairs = x.join(F.broadcast(y), F.col("i") != F.col("j") if same else F.lit(True))
        return pairs.agg(F.avg(F.exp(-d2 / (2 * sigma * sigma))).alias(name))

    x, y = vec(a), vec(b)
    sums = kernel_sum(x, x, True, "xx").join(kernel_sum(y, y, True, "yy")).join(kernel_sum(x, y, False, "xy"))
    mmd = F.greatest(F.col("xx") + F.col("yy") - 2 * F.col("xy"), F.lit(0.0))
    return sums.select(r(mmd).alias("mmd"), (mmd > threshold).alias("drift"))

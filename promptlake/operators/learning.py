"""Learning from signals: consensus of judges, exploration, attribution, the quality model, drift tests, memory and breakers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import RATES
from .finops import r
from .measures import let

# How reliable judges are at first, of others, and bounds.
RELIABILITY = {"gpt4o": 0.85, "heuristic": 0.70}
OTHER_RELIABILITY, LEAST_OF_GPT4O = 0.70, 0.75


def consensus(scores: Column, weights: Column, is_main: Column, rounds: int = 20, settled: float = 1e-4) -> Column:
    """Scores of several judges, weighed by reliabilities that follow from how far each is from the mean: value, rounds and whether it
    settled. ``is_main`` marks the judge whose reliability has a floor."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = lambda w: total(F.zip_with(scores, w, lambda s, x: s * x)) / F.greatest(total(F.transform(w, lambda x: F.greatest(x, F.lit(0.01)))), F.lit(0.01))
    clamp = lambda x: F.greatest(F.lit(0.1), F.least(F.lit(0.99), x))

    def step(state: Column, i: Column) -> Column:
        errors = F.zip_with(scores, is_main, lambda s, m: let(clamp(1.0 - F.abs(s - state["value"])), lambda x: F.when(m, F.greatest(x, F.lit(LEAST_OF_GPT4O))).otherwise(x)))
        new = let(mean(errors), lambda v: F.struct(v.alias("value"), i.alias("rounds"), (F.abs(v - state["value"]) < settled).alias("settled")))
        return F.when(state["settled"], state).otherwise(new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(mean(weights).alias("value"), F.lit(0).alias("rounds"), F.lit(False).alias("settled")), step)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function by its series, to eight places."""
    z = x / F.sqrt(F.lit(2.0))
    term = lambda s, n: let(s["term"] * -z * z / n, lambda t: F.struct(t.alias("term"), (s["sum"] + t / (2 * n + 1)).alias("sum")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(70)), F.struct(z.alias("term"), z.alias("sum")), term, lambda s: s["sum"])
    erf = F.when(F.abs(z) > 4.0, F.signum(z)).otherwise(series * 2 / F.sqrt(F.lit(float(np.pi))))
    return 0.5 * (1.0 + erf)


def knowledge_gradient(mean: Column, variance: Column, best_other: Column) -> Column:
    """What one more sample of an arm is worth against the best of the others."""
    sigma = F.sqrt(variance)
    gap = F.abs(mean - best_other)
    pdf = lambda x: F.exp(-x * x / 2.0) / F.sqrt(F.lit(float(2 * np.pi)))
    gain = let(gap / sigma, lambda x: sigma * pdf(x) + gap * normal_cdf(x) - gap)
    return F.when(variance <= 0, 0.0).otherwise(F.greatest(gain, F.lit(0.0)))


def exploration_arms(states: DataFrame, context: tuple[str, ...], price: Column, share: float, cost: float, failure: float, contract_days: int = 999, least_days: int = 90) -> DataFrame:
    """For each context the rate that is worth exploring, or null. states: context, rate, expected_quality, variance, n_samples, token_count."""
    arms = F.sort_array(F.collect_list(F.struct("rate", "expected_quality")))  # one per rate
    others = states.groupBy(*context).agg(arms.alias("arms"))
    best = F.array_max(F.transform(F.filter("arms", lambda a: F.abs(a["rate"] - F.col("rate")) > 0.001), lambda a: a["expected_quality"]))
    s = states.join(others, list(context)).withColumn("kg", knowledge_gradient(F.col("expected_quality"), F.col("variance"), F.coalesce(best, F.lit(0.0))))
    net = F.col("token_count") * F.col("rate") * price * F.col("kg") * (1.0 - F.col("expected_quality")) * share - cost - failure * 0.5
    worth = (F.col("rate") != 0) & (F.col("n_samples") >= 2) & (F.col("kg") > 0.01) & (net > 0) & F.lit(contract_days >= least_days)
    return s.groupBy(*context).agg(F.max_by("rate", F.when(worth, F.struct("kg", (-F.col("rate")).alias("first")))).alias("explore"))


# How reliable models are, the rate from which compression is high, and complexity from which a model is strained.
MODEL_RELIABILITY = (("gpt-4o", 0.95), ("claude-3.5-sonnet", 0.93), ("gemini-1.5-pro", 0.90), ("gpt-3.5-turbo", 0.75), ("gemini-1.5-flash", 0.80))
HIGH_RATE, COMPLEX = 0.40, 0.6


def attribute(rate: Column, model: Column, specificity: Column, task: Column, bucket: Column, reformulation: Column, continuation: Column, high: float = HIGH_RATE, complex_: float = COMPLEX) -> Column:
    """What a reformulated request blames: cause and confidence, the greatest of four normalised scores (the first on a tie)."""
    reliable = F.lit(0.85)
    for name, value in reversed(MODEL_RELIABILITY):
        reliable = F.when(F.contains(F.lower(model), F.lit(name)), value).otherwise(reliable)
    hard = F.when(specificity == "entity_rich", 0.4).when(specificity == "domain_jargon", 0.2).otherwise(0.0) + F.when(task.isin("creatif", "brainstorming", "instruction"), 0.2).otherwise(0.0)
    hard = F.least(hard + F.when(bucket.isin("long", "very_long"), 0.2).otherwise(0.0), F.lit(1.0))

    def blame(x: Column) -> Column:
        scores = (F.when(rate >= high, 0.6).otherwise(0.1), F.when(x > complex_, 0.7).otherwise(0.4) * (1.0 - reliable), F.lit(0.15), 0.2 * (F.least(x, F.lit(0.5)) / 0.5))
        options = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("first"), F.lit(n).alias("cause")) for i, (n, s) in enumerate(zip(("compression", "model", "user", "context"), scores, strict=True))])
        total = lambda o: F.aggregate(o, F.lit(0.0), lambda s, y: s + y["score"])
        return let(options, lambda o: let(F.array_max(o), lambda best: F.struct(best["cause"].alias("cause"), (best["score"] / total(o)).alias("confidence"))))

    said = lambda c, v: F.struct(F.lit(c).alias("cause"), F.lit(v).alias("confidence"))
    return F.when(~reformulation & continuation, said("user", 0.4)).when(~reformulation, said("user", 0.3)).otherwise(let(hard, blame))


def counts_for_quality(a: Column) -> Column:
    """Whether a request with this attribution updates its cell."""
    return ((a["cause"] == "compression") & (a["confidence"] > 0.5)) | ~(((a["cause"] == "model") & (a["confidence"] > 0.7)) | ((a["cause"] == "user") & (a["confidence"] > 0.6)))


def signal_weight(signal: Column, similarity: Column, gap: Column, soon: int = 30, later: int = 60) -> Column:
    """How much a signal counts: by likeness and time for a reformulation, by time for a continuation."""
    left = lambda w: F.greatest(F.lit(0.0), 1.0 - gap / w)
    again = 0.6 * (0.5 + 0.5 * F.greatest(F.lit(0.0), 1.0 - similarity)) * (0.5 + 0.5 * left(soon))
    return F.when(signal == "reformulation", again).when(signal == "continuation", 0.4 * (0.5 + 0.5 * left(later))).otherwise(0.1)


def pseudo_label(copy: Column, continuation: Column, reformulation: Column, thumbs_up: Column, task_success: Column) -> Column:
    """A grade of a request from its signals (0 or 1 each), the strongest first."""
    return (
        F.when((task_success == 1) | ((copy == 1) & (continuation == 1)), 1.0).when(thumbs_up == 1, 0.95).when(copy == 1, 0.85)
        .when((continuation == 1) & (reformulation == 0), 0.75).when(reformulation == 1, 0.20).otherwise(0.50)
    )


# What is encoded one place each.
TASK_TYPES = ("code", "analytique", "creatif", "factuel", "traduction", "resume", "brainstorming", "instruction")
SPECIFICITIES, LENGTHS = ("generic", "domain_jargon", "entity_rich"), ("short", "medium", "long", "very_long")


def encoded(task: Column, specificity: Column, bucket: Column, cluster: Column, model: Column, rate: Column, length: Column, signals: dict[str, Column]) -> Column:
    """Features of a request as an array of numbers: one place per task, specificity and length, four scaled numbers, the signals and two
    of their products. A model's number comes from a digest, so that it stays."""
    one = lambda c, values: [F.when(c == v, 1.0).otherwise(0.0) for v in values]
    hashed = F.conv(F.substring(F.sha2(model, 256), 1, 8), 16, 10).cast("long") % 100 / 100.0
    s = {k: F.least(v.cast("double"), F.lit(1.0)) for k, v in signals.items()}
    both = [F.when((s["copy"] > 0.5) & (s["continuation"] > 0.5), 1.0).otherwise(0.0), F.when((s["reformulation"] > 0.5) & (s["copy"] < 0.5), 1.0).otherwise(0.0)]
    places = [*one(task, TASK_TYPES), *one(specificity, SPECIFICITIES), *one(bucket, LENGTHS), cluster / 20.0, hashed, rate, F.least(length / 2000.0, F.lit(1.0)), *s.values(), *both]
    return F.array(*[p.cast("double") for p in places])


def quality_model(rows: DataFrame, rounds: int = 40):
    """Gradient-boosted trees on features (array) and label; the fitted model predicts, within [0, 1], by ``predicted``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    data = rows.select(array_to_vector("features").alias("features"), "label")
    return GBTRegressor(maxDepth=4, maxIter=rounds, stepSize=0.05, seed=42).fit(data)


def predicted(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    out = model.transform(rows.withColumn("_array", F.col("features")).withColumn("features", array_to_vector("features")))
    return out.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction", "features").withColumnRenamed("_array", "features")


def context_embeddings(matrix: DataFrame, columns: list[str], size: int = 4, least: int = 50) -> DataFrame:
    """context and its embedding: rows of U sqrt(S) of the matrix of contexts by rates (missing: .5). Only the product of the matrix with
    itself, a row and column per rate, reaches the driver. Fewer contexts than ``least`` have none."""
    cells = [F.coalesce(F.col(c), F.lit(0.5)) for c in columns]
    products = [F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(cells) for j, b in enumerate(cells)]
    found = matrix.agg(F.count("*").alias("n"), *products).first()
    if found["n"] < least:
        return matrix.select("context", F.array().cast("array<double>").alias("embedding")).limit(0)
    values, vectors = np.linalg.eigh(np.array(found[1:], float).reshape(len(columns), -1))
    order = np.argsort(-values)[:size]
    scale = np.where(values[order] > 1e-12, np.maximum(values[order], 1e-300) ** -0.25, 0.0)  # M V / S times sqrt(S), S the roots of the values
    sign = np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    weights = vectors[:, order] * scale * sign
    row = F.array(*cells)
    return matrix.select("context", F.array(*[F.aggregate(F.zip_with(row, F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for w in weights.T]).alias("embedding"))


def permutation_p_value(a: DataFrame, b: DataFrame, features: list[str], rounds: int = 500, sigma: float = 1.0) -> DataFrame:
    """How rarely relabelled rows of two bounded windows (a hundred rows each, say) differ as much as they do: the mean discrepancy,
    and the share of ``rounds`` orders of their rows, spread over tasks, that reach it."""
    x, y = (np.array([list(row) for row in d.select(*features).collect()], float).reshape(-1, len(features)) for d in (a, b))
    both = np.concatenate((x, y))
    shared = a.sparkSession.sparkContext.broadcast((np.exp(-((both[:, None, :] - both[None, :, :]) ** 2).sum(-1) / (2 * sigma * sigma)), len(x)))

    def discrepancy(order: np.ndarray) -> float:
        kernel, n = shared.value
        p, q = order[:n], order[n:]
        mean = lambda k: (k.sum() - np.trace(k)) / max(1, len(k) * (len(k) - 1))
        return max(0.0, mean(kernel[np.ix_(p, p)]) + mean(kernel[np.ix_(q, q)]) - 2 * kernel[np.ix_(p, q)].mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value[0])
        seen = discrepancy(np.arange(n))
        for batch in batches:
            hits = [i for i in batch.column(0).to_pylist() if discrepancy(np.random.default_rng(i).permutation(n)) >= seen]
            yield pa.RecordBatch.from_arrays([pa.array([len(hits)], pa.int64()), pa.array([seen])], names=["hits", "mmd"])

    found = a.sparkSession.range(0, rounds, 1, 8).mapInArrow(run, "hits long, mmd double")
    return found.agg(r(F.max("mmd")).alias("mmd"), r((F.sum("hits") + 1) / F.lit(float(rounds + 1))).alias("p_value"))


def recent(samples: DataFrame, key: str, order: list[str], value: str, size: int = 100) -> DataFrame:
    """samples with the number and mean of the last ``size`` values of each key up to each row; sums are of millionths, so that
    their order does not tell."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    millionths = F.round(F.col(value) * 1e6).cast("long")
    return samples.withColumns({"n": F.count(value).over(w), "mean": r(F.sum(millionths).over(w) / F.count(value).over(w) / 1e6)})


# --- circuit breaker


class Breaker:
    """Closed until ``failures`` failures in a row, then open; after ``wait`` seconds half open for ``trials`` calls, closed by a success."""

    def __init__(self, failures: int = 5, wait: float = 30.0, trials: int = 2):
        self.most, self.wait, self.trials = failures, wait, trials
        self.state, self.failed, self.since, self.tried = "closed", 0, 0.0, 0

    def event(self, at: float, ok: bool) -> tuple[bool, str]:
        """Whether a call at a time is let through, and the state after its outcome."""
        if self.state == "open" and at - self.since >= self.wait:
            self.state, self.tried = "half_open", 0
        if self.state == "open" or self.state == "half_open" and self.tried >= self.trials:
            return False, self.state
        self.tried += self.state == "half_open"
        if ok:
            self.state, self.failed = "closed", 0
        else:
            self.failed, self.since = self.failed + 1, at
            if self.state == "half_open" or self.failed >= self.most:
                self.state = "open"
        return True, self.state


def breaker_log(events: DataFrame) -> DataFrame:
    """provider, at (seconds), id, ok with ``allowed`` and ``state``: each provider's events in order of time, streamed through its
    breaker without being gathered. What a breaker does depends on all that went before, so that one provider is one task's work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, breaker = None, Breaker()
        for batch in batches:
            out = []
            for provider, at, ok in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if provider != name:
                    name, breaker = provider, Breaker()
                out.append(breaker.event(at, ok))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in out], pa.bool_()), pa.array([s for _, s in out], pa.string())], names=[*batch.schema.names, "allowed", "state"])

    rows = events.select("provider", F.col("at").cast("double").alias("at"), F.col("id").cast("long").alias("id"), "ok")
    return rows.repartition("provider").sortWithinPartitions("provider", "at", "id").mapInArrow(run, "provider string, at double, id long, ok boolean, allowed boolean, state string")


# --- memory


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """A vector of length 1 and 384 normal numbers that a text's digest seeds."""
    def of(text: str | None) -> list[float]:
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big"))
        v = rng.standard_normal(384)
        return (v / (np.linalg.norm(v) + 1e-9)).tolist()

    return texts.map(of, na_action=None)


def best_of_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """query, id and cosine of the k best and one more for each query of a block, for pairs (mine, theirs) of blocks. One pair is held at a time."""
    def side(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of a block, from Arrow's own buffers."""
        rows = pa.array(rows.values)
        ids, v = rows.field("id").to_numpy(), rows.field("v")
        return ids, v.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(ids), -1)

    for batch in batches:
        for at in range(batch.num_rows):  # a pair of blocks at a time
            (mine, q), (ids, v) = (side(batch.column(c)[at]) for c in (0, 1))
            cosine = q @ v.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :] + 1e-9)
            cosine[mine[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-cosine, axis=1, kind="stable")[:, : k + 1]
            rows = [(int(x), int(ids[j]), float(cosine[i, j])) for i, x in enumerate(mine) for j in best[i] if np.isfinite(cosine[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array([y[c] for y in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query", "id", "cosine"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 500) -> DataFrame:
    """query, id, cosine, rank: the k vectors (id, v) most alike to each query (query, v) but itself. Both are cut into blocks of about
    ``block`` rows; blocks meet each other, not rows, and of each block only the k best of a query go on."""
    def blocks(rows: DataFrame, key: str, name: str) -> DataFrame:
        n = max(1, -(-rows.count() // block))
        return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n))).agg(F.collect_list(F.struct(F.col(key).alias("id"), "v")).alias(name)).select(name)

    pairs = blocks(queries, "query", "mine").repartition(8).join(F.broadcast(blocks(vectors, "id", "theirs")) if vectors.count() <= 20_000 else blocks(vectors, "id", "theirs"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id")
    return pairs.mapInArrow(partial(best_of_blocks, k=k), "query long, id long, cosine double").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


RATE_COLUMNS = [f"rate_{int(round(x * 100)):02d}" for x in RATES]

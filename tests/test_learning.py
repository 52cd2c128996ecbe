"""Learning operators against plain Python, worked examples and each other."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.operators import decision as de
from promptlake.operators import finops as fo
from promptlake.operators import learning as le


def plain_consensus(scores, weights):
    value = sum(s * w for s, w in zip(scores, weights)) / sum(max(w, 0.01) for w in weights)
    for i in range(1, 21):
        before = value
        rel = [max(0.1, min(0.99, 1 - abs(s - value))) for s in scores]
        rel[0] = max(rel[0], 0.75)
        value = sum(s * x for s, x in zip(scores, rel)) / sum(rel)
        if abs(value - before) < 1e-4:
            return value, i, True
    return value, 20, False


def test_consensus(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(30)] + [(30, [1.0, 1.0, 1.0]), (31, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, s array<double>")
    w, main = F.array(F.lit(0.85), F.lit(0.7), F.lit(0.7)), F.array(F.lit(True), F.lit(False), F.lit(False))
    for r in df.select("s", le.consensus(F.col("s"), w, main).alias("c")).collect():
        value, rounds, settled = plain_consensus(r.s, (0.85, 0.7, 0.7))
        assert math.isclose(r.c.value, value, abs_tol=1e-9) and (r.c.rounds, r.c.settled) == (rounds, settled)


def test_normal_cdf_and_knowledge_gradient(spark):
    xs = [0.0, 0.3, 1.0, -1.0, 2.5, 4.0, 5.5, 9.0]
    got = [r.x for r in spark.createDataFrame([(x,) for x in xs], "v double").select(le.normal_cdf(F.col("v")).alias("x")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-7)
    rows = [(0.5, 0.04, 0.7), (0.9, 0.01, 0.2), (0.5, 0.0, 0.4)]

    def kg(m, v, o):
        if v <= 0:
            return 0.0
        s, d = math.sqrt(v), abs(m - o)
        return max(s * math.exp(-0.5 * (d / s) ** 2) / math.sqrt(2 * math.pi) + d * 0.5 * (1 + math.erf(d / s / math.sqrt(2))) - d, 0.0)

    got = [r.x for r in spark.createDataFrame(rows, "m double, v double, o double").select(le.knowledge_gradient(F.col("m"), F.col("v"), F.col("o")).alias("x")).collect()]
    assert got == pytest.approx([kg(*x) for x in rows], abs=1e-7)


def test_exploration_arm(spark):
    rows = [("c", 0.0, 1.0, 0.01, 9.0, 10**9), ("c", 0.25, 0.6, 0.2, 5.0, 10**9), ("c", 0.4, 0.5, 0.3, 1.0, 10**9), ("d", 0.25, 0.6, 0.2, 5.0, 10), ("e", 0.7, 0.5, 0.25, 3.0, 10**9), ("e", 0.4, 0.5, 0.25, 3.0, 10**9)]
    s = spark.createDataFrame(rows, "context string, rate double, expected_quality double, variance double, n_samples double, token_count long")
    got = {r.context: r.explore for r in le.exploration_arms(s, ("context",), F.lit(5e-6), 0.2, 0.0001, 0.01).collect()}
    assert got == {"c": 0.25, "d": None, "e": 0.4}
    assert {r.explore for r in le.exploration_arms(s, ("context",), F.lit(5e-6), 0.2, 0.0001, 0.01, contract_days=10).collect()} == {None}


def test_attribution(spark):
    rows = [(0.55, "gpt-4o", "generic", "code", "short", True, False), (0.15, "gpt-3.5-turbo", "generic", "code", "short", True, False), (0.15, "x", "entity_rich", "creatif", "long", True, True), (0.7, "x", "generic", "code", "short", False, True), (0.7, "x", "generic", "code", "short", False, False)]
    df = spark.createDataFrame(rows, "r double, m string, s string, t string, b string, f boolean, c boolean")
    a = le.attribute(*[F.col(c) for c in "rmstbfc"])
    got = [(r.a.cause, round(r.a.confidence, 6), r.n) for r in df.select(a.alias("a"), le.counts_for_quality(a).alias("n")).collect()]
    first = {"compression": 0.6, "model": 0.4 * 0.05, "user": 0.15, "context": 0.0}
    assert got[0] == ("compression", round(0.6 / sum(first.values()), 6), True)
    assert got[1][0] == "user" and got[2][0] == "context" and got[3] == ("user", 0.4, True) and got[4] == ("user", 0.3, True)


def test_breaker_follows_its_state(spark):
    events = [(t, False) for t in range(5)] + [(6, True), (33, True), (34.5, False), (40, True), (65, True), (66, True)]
    b = le.Breaker()
    got = [b.event(t, ok) for t, ok in events]
    assert [a for a, _ in got] == [True] * 5 + [False, False, True, False, True, True]
    assert [s for _, s in got] == ["closed"] * 4 + ["open"] * 3 + ["open", "open", "closed", "closed"]
    rows = [(p, float(t), i, ok) for p in ("a", "b", "c") for i, (t, ok) in enumerate(events)]
    random.Random(2).shuffle(rows)
    log = le.breaker_log(spark.createDataFrame(rows, "provider string, at double, id long, ok boolean")).collect()
    for p in ("a", "b", "c"):
        assert [(r.allowed, r.state) for r in sorted((r for r in log if r.provider == p), key=lambda r: r.at)] == got


def test_quality_model_learns(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.random() > 0.5), rng.random()], 0.0) for i in range(400)]
    rows = [(i, f, 0.9 if f[0] else 0.2) for i, f, _ in rows]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double")
    out = le.predicted(le.quality_model(df, rounds=60), df).collect()
    assert np.mean([abs(r.quality - r.label) for r in out]) < 0.1 and all(0 <= r.quality <= 1 for r in out)


def test_context_embeddings_are_the_decomposition(spark):
    rng = np.random.default_rng(4)
    m = rng.random((60, 6))
    df = spark.createDataFrame([(f"c{i}", *map(float, row)) for i, row in enumerate(m)], "context string, a double, b double, c double, d double, e double, f double")
    got = {r.context: np.array(r.embedding) for r in le.context_embeddings(df, list("abcdef")).collect()}
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = u[:, :4] * np.sqrt(s[:4])
    found = np.array([got[f"c{i}"] for i in range(60)])
    assert np.allclose(np.abs(found), np.abs(want), atol=1e-6)
    assert le.context_embeddings(df.limit(10), list("abcdef")).count() == 0


def test_permutation_p_value(spark):
    near = spark.createDataFrame([(float(i % 5),) for i in range(40)], "x double")
    far = near.select((F.col("x") + 3).alias("x"))
    assert le.permutation_p_value(near, far, ["x"], 100).first().p_value < 0.05
    assert le.permutation_p_value(near, near, ["x"], 100).first().p_value > 0.5


def test_nearest_against_all(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((90, 8))
    vectors = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in le.nearest(vectors, vectors.filter("id % 20 = 0").withColumnRenamed("id", "query"), k=4, block=25).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.id
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 90, 20):
        want = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == want


def test_hash_embedding_is_stable(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string").select(le.hash_embedding(F.col("t")).alias("v"))
    a, b, c, d = [np.array(r.v) for r in df.collect()]
    assert (a == b).all() and abs(a @ c) < 0.3 and all(abs(np.linalg.norm(x) - 1) < 1e-6 for x in (a, c, d))


def test_changes_and_latest(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changes = spark.createDataFrame([(1, None, "delete"), (2, "B", "update"), (9, "z", "insert")], "k long, v string, op string")
    assert sorted(map(tuple, fo.apply_changes(rows, changes, "k").collect())) == [(2, "B"), (3, "c"), (9, "z")]
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k long, at long, v string")
    assert sorted(map(tuple, fo.latest_by(log, ["k"], ["at"]).collect())) == [(1, 3, "c"), (2, 1, None)]


def test_explained_rates(spark):
    x = spark.range(1).select(de.explain_rates(F.lit(1000), 5e-6, 0.9).alias("x")).first().x
    assert [r.rate for r in x] == [0.0, 0.15, 0.25, 0.4, 0.55, 0.7] and x[0].savings == 0

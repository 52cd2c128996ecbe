"""Streams of keyed state against their batch forms, a file at a time, with a restart from the checkpoint in between."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptlake.operators import governance as go
from promptlake.operators import learning as le
from promptlake.sources import tables as t
from promptlake.streaming import services as sv


@pytest.fixture
def calls(spark, sf_dir):
    """Events of services in order of time and id."""
    e = t.read(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), F.to_timestamp_ltz(F.date_trunc("second", "ts").cast("string")).alias("at"), F.col("event_id").alias("id"), F.col("value").alias("duration_ms"))
    return e.withColumns({"provider": F.col("endpoint"), "ok": F.col("duration_ms") < 20, "user_id": F.col("endpoint"), "quality": F.round(F.col("duration_ms") / 500, 6)})


def replayed(spark, rows, folder, transform, mode, parts=4):
    """What a stream over ``parts`` files in order of time gives; it is stopped after half of them and started again."""
    ordered = rows.toPandas().sort_values(["at", "id"])
    step = -(-len(ordered) // parts)
    found = []
    for k in range(parts):
        part = spark.createDataFrame(ordered.iloc[k * step : (k + 1) * step], rows.schema)
        part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if k % 2 == 0:
            continue
        stream = transform(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
        # files are written in order, and their time is what the source orders by
        query = stream.writeStream.foreachBatch(lambda df, i: found.append((i, df.collect()))).outputMode(mode).option("checkpointLocation", str(folder / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return [r for _, batch in found for r in batch]


def test_breaker(spark, calls, tmp_path):
    rows = calls.select("provider", "at", "id", "ok")
    got = replayed(spark, rows, tmp_path, sv.breaker_stream, "append")
    want = le.breaker_log(rows.withColumn("at", F.col("at").cast("double"))).collect()
    key = lambda r: (r.provider, r.at, r.id, r.ok, r.allowed, r.state)
    assert sorted(key(r) for r in got if r.id is not None) == sorted(map(key, want))
    assert {r.state for r in got} > {"open"} and all(r.state == "half_open" for r in got if r.id is None)


def test_breaker_timer(spark, tmp_path):
    """A breaker opens, no call comes to it, and the time of others lets it say that it is half open."""
    base = 1_700_000_000
    rows = [("a", base + i, i, False) for i in range(5)] + [("b", base + 100 + i, 10 + i, True) for i in range(6)] + [("a", base + 200, 20, True)]
    df = spark.createDataFrame(rows, "provider string, s long, id long, ok boolean").select("provider", F.timestamp_seconds("s").alias("at"), "id", "ok")
    got = [(r.provider, r.id, r.allowed, r.state) for r in replayed(spark, df, tmp_path, sv.breaker_stream, "append", 4)]
    assert got.index(("a", None, None, "half_open")) < got.index(("a", 20, True, "closed"))
    assert ("a", 4, True, "open") in got and ("a", 20, True, "closed") in got


def test_latency(spark, calls, tmp_path):
    got = {}
    for r in replayed(spark, calls.select("endpoint", "at", "id", "duration_ms"), tmp_path, sv.latency_stream, "update"):
        got[r.endpoint] = (r.n, round(r.ema_ms, 4))
    counts = {r.endpoint: r["count"] for r in calls.groupBy("endpoint").count().collect()}
    want = {r.endpoint: (counts[r.endpoint], r.ema_ms) for r in go.latency_ema(calls).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_traces(spark, calls, tmp_path):
    got = {r.endpoint: list(r.ids) for r in replayed(spark, calls.select("endpoint", "at", "id", "duration_ms"), tmp_path, lambda e: sv.trace_stream(e, 20), "update")}
    want = {}
    for r in sorted(go.recent_traces(calls, 20).collect(), key=lambda r: r["rank"]):
        want.setdefault(r.endpoint, []).append(r.id)
    assert got == want


def test_drift_window(spark, calls, tmp_path):
    rows = calls.select("user_id", "at", "id", "quality")
    got = {(r.user_id, r.id): (r.n, round(r.mean, 6)) for r in replayed(spark, rows, tmp_path, sv.drift_stream, "append")}
    want = {(r.user_id, r.id): (r.n, r["mean"]) for r in le.recent(rows, "user_id", ["at", "id"], "quality").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)

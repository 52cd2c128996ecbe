"""Keyed state of services over a stream: circuit breakers with a recovery timer, moving averages, rings of the latest, drift windows.

Each operator keeps one small state a key (bounded by a parameter), and takes a micro-batch's rows of a key in the order of their time and
id, so that a stream whose micro-batches come in order gives what the batch forms give, also after a restart from its checkpoint.
A row with a null key is a row of the key null; a null outcome counts as a failure, a null value is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.learning import Breaker


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of this micro-batch in order; they arrive in slices."""
    return pd.concat([*batches]).sort_values(["at", "id"], kind="stable")


def breaker_stream(events: DataFrame, failures: int = 5, wait: float = 30.0, trials: int = 2, late: str = "0 seconds") -> DataFrame:
    """events (provider, at: timestamp, id, ok) with ``allowed`` and ``state``. An open breaker whose wait is over by the watermark says so in a row
    of its own, without id, even where no call comes."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker, out = Breaker(failures, wait, trials), []
        if state.exists:
            breaker.state, breaker.failed, breaker.since, breaker.tried = state.get
        if state.hasTimedOut:
            breaker.state, breaker.tried = "half_open", 0
            out.append((key[0], breaker.since + wait, None, None, None, breaker.state))
        else:
            for row in _rows(batches).itertuples():
                at = row.at.timestamp()
                allowed, now = breaker.event(at, bool(row.ok) if row.ok is not None else False)
                out.append((key[0], at, row.id, row.ok, allowed, now))
        state.update((breaker.state, breaker.failed, breaker.since, breaker.tried))
        if breaker.state == "open":
            state.setTimeoutTimestamp(max(int((breaker.since + wait) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["provider", "at", "id", "ok", "allowed", "state"]).astype({"id": "Int64", "ok": "boolean", "allowed": "boolean"})

    timed = events.withWatermark("at", late).groupBy("provider")
    kind = events.schema["provider"].dataType.simpleString()
    schema = f"provider {kind}, at double, id long, ok boolean, allowed boolean, state string"
    return timed.applyInPandasWithState(run, schema, "state string, failed long, since double, tried long", "append", GroupStateTimeout.EventTimeTimeout)


def _kept(events: DataFrame, key: str, value: str, step: Callable, schema: str, state: str, mode: str, start: tuple) -> DataFrame:
    """step(kept, rows) gives the new state and what goes out, for each key with rows in a micro-batch."""
    def run(keys: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        kept, out = step(group.get if group.exists else start, _rows(batches))
        group.update(kept)
        out.insert(0, key, [keys[0]] * len(out))
        yield out

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "at", "id", F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", state, mode, GroupStateTimeout.NoTimeout)


def latency_stream(events: DataFrame, keep: float = 0.9) -> DataFrame:
    """endpoint, n and ema_ms so far: exponential moving averages, from 0, of events (endpoint, at, id, duration_ms)."""
    def step(kept: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        n, ema = kept
        for x in rows["value"]:
            ema = keep * ema + (1 - keep) * x
        n += len(rows)
        return (n, ema), pd.DataFrame({"n": [n], "ema_ms": [ema]})

    return _kept(events, "endpoint", "duration_ms", step, "n long, ema_ms double", "n long, ema double", "update", (0, 0.0))


def trace_stream(events: DataFrame, k: int = 1000) -> DataFrame:
    """endpoint and the ids of its k latest events, the latest first, of events (endpoint, at, id, duration_ms)."""
    def step(kept: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        ids = [*rows["id"].tolist()[::-1], *kept[0]][:k]
        return (ids,), pd.DataFrame({"ids": [ids]})

    return _kept(events, "endpoint", "duration_ms", step, "ids array<long>", "ids array<long>", "update", ([],))


def drift_stream(samples: DataFrame, size: int = 100) -> DataFrame:
    """Each sample of samples (user_id, at, id, quality) with the number and mean of its user's last ``size`` up to it; sums are of millionths."""
    def step(kept: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        window, out = list(kept[0]), []
        for i, x in zip(rows["id"], rows["value"]):
            window = [*window, round(x * 1e6)][-size:]
            out.append((i, len(window), sum(window) / len(window) / 1e6))
        return (window,), pd.DataFrame(out, columns=["id", "n", "mean"])

    return _kept(samples, "user_id", "quality", step, "id long, n long, mean double", "window array<long>", "append", ([],))

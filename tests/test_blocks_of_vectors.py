"""Pairs of blocks of vectors are held one at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from promptlake.operators import learning as le


def test_one_pair_of_blocks_at_a_time():
    v = np.random.default_rng(3).normal(size=(100, 64))
    block = [{"id": i, "v": x.tolist()} for i, x in enumerate(v)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([block[:50]] * 60, kind), pa.array([block] * 60, kind)], names=["mine", "theirs"])
    tracemalloc.start()
    first = next(le.best_of_blocks(iter([batch]), 5)).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000  # the batch as Python's numbers takes over 15 MB
    cosine = v @ v.T / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :] + 1e-9)
    np.fill_diagonal(cosine, -np.inf)
    assert [(x["query"], x["id"]) for x in first] == [(i, int(j)) for i in range(50) for j in np.argsort(-cosine[i], kind="stable")[:6]]

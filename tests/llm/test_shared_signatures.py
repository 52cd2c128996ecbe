"""Signatures of op5 that more than one text has."""

from __future__ import annotations

import random
from collections import Counter

from promptlake.llm import jaccard_join as jj


def test_shared_signatures(spark):
    """Each is dealt out once, with its text, and comes back where another text has it too, whatever the number of buckets."""
    draw = random.Random(5)
    rows = [(i, [draw.randrange(-900, 900) << 40 for _ in range(i % 40)]) for i in range(300)] + [(300, [7 << 40]), (301, [7 << 40]), (302, [11 << 40]), (None, [11 << 40])]
    rows = [(i, sorted(set(sigs))) for i, sigs in rows]
    count = Counter(s for i, sigs in rows if i is not None for s in sigs)
    wanted = sorted((s, i) for i, sigs in rows if i is not None for s in sigs if count[s] > 1)
    signed = spark.createDataFrame(rows, "doc_id long, sigs array<long>").repartition(3)
    for buckets in (1, 5):
        assert sorted(map(tuple, jj._shared_signatures(signed, buckets, "bigint").collect())) == wanted

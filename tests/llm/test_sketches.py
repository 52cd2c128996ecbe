"""Sketches of op5's sets, which meet before the sets do."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.llm import jaccard_join as jj


def test_sketches_never_differ_more_than_sets():
    draw = np.random.default_rng(3)
    for size in (1, 5, 11, 12, 40, 300, 1100):
        a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        assert 4 * len(jj.sketch(a)) >= 3 * len(a)
        for changed in (0, 1, size // 5, size):
            b = np.unique(np.concatenate((a[changed:], draw.integers(0, 1 << 63, 2 * changed).astype(np.uint64))))
            found = jj.differing_cells(jj.sketch(a), jj.sketch(b))
            assert found == jj.differing_cells(jj.sketch(b), jj.sketch(a)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [80, 85])
def test_far_pairs_move_no_sets(spark, percent):
    """Of texts under one pivot with which they share a passage only, no set is made, and all links are found."""
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(i, passage + " " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(40)] + [(40, passage + " " + " ".join(f"w7x{k}" for k in range(60)) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams, made = jj._grams(docs, 4, "bigint").withColumnRenamed("grams", "all"), []

    def sets(nodes, name):
        found = jj.materialize(grams.withColumnRenamed("all", "grams").join(nodes, "node", "left_semi"), name)
        made.append(found.count())
        return found

    sketches = jj.materialize(jj._sketches(docs, lambda x: jj.ngram_set(x, 4), "bigint"), "sketches")
    links = jj._Links(None, percent, sketches, sets)
    pairs = docs.select(F.col("doc_id").alias("a"), F.lit(7).cast("long").alias("b")).filter("a <> b")
    found = {r.a: (r.link, r.near) for r in links.check(pairs, near=True).collect()}
    assert found == {i: (i == 40, i == 40) for i in range(41) if i != 7}
    assert made == [2]

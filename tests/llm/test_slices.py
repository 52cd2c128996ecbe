"""op2's buckets answer slices of documents."""

from __future__ import annotations

import random

import numpy as np

from promptlake.llm import lm_scoring as lm


def test_rows_of_buckets_do_not_grow_with_documents(spark):
    """A bucket has one row for each slice, however many documents are in it, and sums are those of any number of buckets."""
    draw = random.Random(4)
    rows = [(i if i % 50 else None, " ".join(f"w{draw.randrange(40)}" for _ in range(draw.choice((0, 1, 2, 30))))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    sums = []
    for buckets in (1, 40):
        answers = lm._of_buckets(lm._dealt(docs, 3, buckets, np.zeros(0, np.uint64), "bigint"), "bigint").cache()
        assert answers.count() <= 2 * buckets
        found = lm._of_slices(answers, "bigint").collect()
        assert len(found) == sum(bool(text) for _, text in rows)
        sums.append({r.doc_id: (round(r.part, 6), r.words, r.asks) for r in found if r.doc_id is not None})
    assert sums[0] == sums[1]
    assert {i: n for i, (_, n, _) in sums[0].items()} == {i: len(text.split()) for i, text in rows if i is not None and text}

"""Protected blocks of texts, a hundred texts at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.operators import language as la


def test_protected_blocks_hold_few_texts(spark):
    rows = spark.createDataFrame([(0, "a ```py\nx\n``` b"), (1, None), (2, "")], "i long, t string").select("i", la.protected_ratio(F.col("t")).alias("p"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r.p for r in rows.orderBy("i").collect()] == [11 / 15, 0.0, 0.0]

"""Nodes of Markdown texts leave a task in portions."""

from __future__ import annotations

from promptlake.operators import markdown as md


def test_nodes_in_portions(spark):
    texts = [None, "", "# a\n- b\n- c", "\n".join(f"- item {i}" for i in range(md.HELD + 3)), "x\n\n## y"]
    found = md.nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").coalesce(1))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # not one array of all nodes of a batch
    got = [r.asDict() for r in found.orderBy("doc_id", "id").collect()]
    assert got == [{"doc_id": i, **x} for i, t in enumerate(texts) for x in md.nodes_of(t)]

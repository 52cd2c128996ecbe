"""Streams over a folder of Parquet files give what the batch gives."""

from promptlake.sources import tables as t
from promptlake.streaming import sessions as ss


def drained(spark, rows, tmp_path, transform, mode):
    rows.write.parquet(str(tmp_path / "in"))
    stream = transform(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("drained").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        return spark.table("drained").collect()
    finally:
        query.stop()


def test_running_cells(spark, sf_dir, tmp_path):
    rows = t.requests(spark, sf_dir)
    got = {tuple(r[c] for c in t.CELL): (round(r.quality_sum, 6), r.n_samples) for r in drained(spark, rows, tmp_path, ss.running_cells, "complete")}
    want = {tuple(r[c] for c in t.CELL): (r.quality_sum, r.n_samples) for r in t.cells(spark, sf_dir).collect()}
    assert got == want


def test_prompt_frequency(spark, sf_dir, tmp_path):
    rows = t.prompt_events(spark, sf_dir)
    got = {r.prompt_key: r.uses for r in drained(spark, rows, tmp_path, ss.prompt_frequency, "complete")}
    assert got == {r.prompt_key: r["count"] for r in rows.groupBy("prompt_key").count().collect()}


def test_session_windows_run(spark, sf_dir, tmp_path):
    rows = t.prompt_events(spark, sf_dir).selectExpr("user_id", "CAST(created_at AS TIMESTAMP) AS created_at")
    assert len(drained(spark, rows, tmp_path, ss.session_windows, "append")) > 0

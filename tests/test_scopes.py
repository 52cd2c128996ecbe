"""Scopes of negation against their SQL where words hold letters beyond ASCII."""

from __future__ import annotations

import duckdb

from promptlake.queries import QUERIES, SQL


def test_scope_sums_of_accented_words(spark, tmp_path):
    texts = [
        "Il est une ééonelle pas.", "Ne mange pas, ne mangé pas, ne été plus", "ne est pas dérangé", "ne éte pas in", "ne est pas in, n'été guère", "Pas sans ne pas", "ne  GUÈRE et ne x y pas", None, "not un, never dis",
    ]
    rows = [(i, x, lang, len(x or "")) for i, (x, lang) in enumerate((x, lang) for x in texts for lang in ("fr", "en"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/all/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/all/documents.parquet/*.parquet')")
    result = con.execute(SQL["e10_scope_sums"])
    columns = [x[0] for x in result.description]
    found = QUERIES["e10_scope_sums"](spark, f"{tmp_path}/all").select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, result.fetchall()))

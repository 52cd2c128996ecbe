"""Markers are searched for where a word that they need is said."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.functions import relations, rules
from promptlake.operators import discourse as di


def test_markers_as_without_the_words(spark):
    phrases = [(lang, p.replace("\\", "")) for lang, by in relations.MARKERS.items() for ps in by.values() for p in ps.split("|")]
    texts = [(lang, f"x {y(p)}, z") for lang, p in phrases for y in (str, str.upper)]
    texts += [("en", x) for x in ("A\u017f is", "\u0131f", "basis", "be\u00adcause", "as\u0301", "_as_", "in\u00a0case", "E.G. this", "")] + [("fr", "D'O\u00d9 vient"), ("en", None)]
    docs = spark.createDataFrame(texts, "lang string, t string")
    plain = F.array(*[
        F.when(F.col("lang") == "fr", F.regexp_extract("t", rules.pattern(relations.MARKERS["fr"][r]), 0)).otherwise(F.regexp_extract("t", rules.pattern(relations.MARKERS["en"][r]), 0)) for r in relations.MARKERS["en"]
    ])
    rows = docs.select(F.filter(plain, lambda x: x != "").alias("a"), di.markers(F.col("t"), F.col("lang"))["marker"].alias("b"))
    assert "arrays_overlap" in rows._jdf.queryExecution().analyzed().toString()
    assert all(r.a == r.b for r in rows.collect())

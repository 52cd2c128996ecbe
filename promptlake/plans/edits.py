"""Queries of example blocks and of differences between prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffs as df
from ..operators import examples as ex
from ..sources import tables as t
from .chunks import _strip
from .clusters import _walk
from .registry import query
from .texts import _APPROX, _PAIRS, _SHINGLES, _pairs

# --- examples


def exampled_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and t: each whole text, a line in seven opening a block of examples, one in fourteen ending it and one in five said twice."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    put = lambda x, i: F.when(i % 7 == 1, F.concat(F.lit("See for example "), x)).when(i % 14 == 6, F.concat(F.lit("# "), x)).when(i % 5 == 0, F.concat(x, F.lit("\n"), x, F.lit(" again"))).otherwise(x)
    return t.read(spark, d, "documents").select("doc_id", F.array_join(F.transform(lines, put), "\n").alias("t"))


_EXAMPLED = """SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 1 THEN 'See for example ' || x WHEN (i - 1) % 14 = 6 THEN '# ' || x
WHEN (i - 1) % 5 = 0 THEN x || chr(10) || x || ' again' ELSE x END), chr(10)) AS t FROM documents"""
_AFTER = _strip(rf"coalesce(regexp_split_to_array(x, '(?i)\b({ex.MARKERS})\s*')[2], '')")
_FOUND = rf"""SELECT doc_id, line, example FROM (SELECT doc_id, line, CASE WHEN opens THEN {_AFTER}
  WHEN coalesce(max(CASE WHEN opens THEN line END) OVER w, -1) > coalesce(max(CASE WHEN NOT opens AND (x = '' OR starts_with(x, '#')) THEN line END) OVER w, -1) THEN x ELSE '' END AS example
FROM (SELECT doc_id, line, x, regexp_matches(x, '(?i)\b({ex.MARKERS})\b') AS opens FROM (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS line, {_strip('unnest(s)')} AS x FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM ({_EXAMPLED}) a) b) c) e
WINDOW w AS (PARTITION BY doc_id ORDER BY line)) f WHERE example <> ''"""


@query(_FOUND)
def f13_examples(spark: SparkSession, d: str) -> DataFrame:
    return ex.examples(exampled_documents(spark, d))


@query(f"""{_walk(f"SELECT doc_id AS scope, line AS node, example AS text FROM ({_FOUND}) q", 70)},
judged AS (SELECT scope, node, count(*) OVER (PARTITION BY scope) <= 3 OR (leader = node AND count(*) FILTER (leader = node) OVER (PARTITION BY scope ORDER BY node) <= 3) AS stays FROM led),
rows AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM ({_EXAMPLED}) a) b)
SELECT r.doc_id, coalesce(string_agg(x, chr(10) ORDER BY r.line) FILTER (j.stays IS NOT FALSE OR contains(x, 'PROTECTED_')), '') AS text, count(*) FILTER (j.stays = false AND NOT contains(x, 'PROTECTED_')) AS removed
FROM rows r LEFT JOIN judged j ON j.scope = r.doc_id AND j.node = r.line GROUP BY r.doc_id""")
def f14_reduced_examples(spark: SparkSession, d: str) -> DataFrame:
    return ex.reduced(exampled_documents(spark, d))


# --- differences

_COST = f"({{0}} / CAST(1000 AS DOUBLE) * CAST({t.PRICES['gpt-4o'][1]} AS DOUBLE) + floor({{0}} * CAST(0.3 AS DOUBLE)) / CAST(1000 AS DOUBLE) * CAST({t.PRICES['gpt-4o'][2]} AS DOUBLE))"


@query(f"""SELECT conv_id, turn, ta AS tokens_a, tb AS tokens_b, tb - ta AS token_delta, round((tb - ta) / CAST(greatest(ta, 1) AS DOUBLE) * 100, 1) AS token_delta_percent, round({_COST.format('ta')}, 6) AS cost_a_usd,
round({_COST.format('tb')}, 6) AS cost_b_usd, round({_COST.format('tb')} - {_COST.format('ta')}, 6) AS cost_delta_usd, round(ratio, 2) AS length_ratio,
CASE WHEN len(lost) > 0 OR ratio < CAST(0.5 AS DOUBLE) THEN 'high' WHEN ratio < CAST(0.75 AS DOUBLE) THEN 'medium' ELSE 'low' END AS risk, array_to_string(lost, ',') AS lost_words
FROM (SELECT conv_id, turn, {_APPROX.format('a')} AS ta, {_APPROX.format('b')} AS tb, length(b) / CAST(greatest(length(a), 1) AS DOUBLE) AS ratio,
  list_sort(list_filter({list(df.CRITICAL)}, lambda w: list_contains({_SHINGLES.replace('text', 'a')}, w) AND NOT list_contains({_SHINGLES.replace('text', 'b')}, w))) AS lost FROM ({_PAIRS}) p WHERE a IS NOT NULL) x""")
def f17_prompt_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the one before it, as two versions of a prompt."""
    return _pairs(spark, d).select("conv_id", "turn", *df.compared(F.col("a"), F.col("b")))


@query("""SELECT a.doc_id, true AS restored, CASE WHEN a.text = b.text THEN 0 ELSE 1 END AS changed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) a
JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) b ON a.source = b.source AND b.k = a.k + 1""")
def f17_hunks_restore(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the next of its source: whether its hunks give that one, and whether there are any."""
    from pyspark.sql import Window

    rows = t.read(spark, d, "documents").withColumn("next", F.lead("text").over(Window.partitionBy("source").orderBy("doc_id"))).filter("next IS NOT NULL")
    rows = rows.withColumn("hunks", df.line_hunks("text", "next"))
    return rows.select("doc_id", (df.applied(F.col("text"), F.col("hunks")) == F.col("next")).alias("restored"), (F.size("hunks") > 0).cast("int").alias("changed"))

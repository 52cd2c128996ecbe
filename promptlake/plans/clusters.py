"""Queries of greedy selection among similar texts. Their SQL is the sequential loop itself, a text at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..sources import tables as t
from .registry import query
from .texts import _SHINGLES


def _walk(texts: str, percent: int) -> str:
    """CTEs on texts (scope, node, text), ending in ``led`` (scope, node, leader, likeness): the loop in order of node within each scope."""
    words = _SHINGLES.replace("text", "coalesce(text, '')")
    return f"""WITH RECURSIVE words AS (SELECT scope, node, {words} AS w FROM ({texts}) x),
sets AS (SELECT scope, node, row_number() OVER (PARTITION BY scope ORDER BY node) AS k,
  CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
members AS (SELECT scope, k, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.scope, a.k AS a, b.k AS b, round(count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE), 6) AS jaccard
  FROM members a JOIN members b ON a.g = b.g AND a.scope IS NOT DISTINCT FROM b.scope AND a.k < b.k GROUP BY 1, 2, 3 HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
earlier AS (SELECT scope, b AS k, list(a) AS before FROM links GROUP BY 1, 2),
steps AS (SELECT s.scope, s.k, coalesce(e.before, []) AS before FROM sets s LEFT JOIN earlier e ON s.k = e.k AND s.scope IS NOT DISTINCT FROM e.scope),
loop AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM sets
  UNION ALL SELECT l.scope, s.k, CASE WHEN len(list_intersect(l.kept, s.before)) = 0 THEN list_append(l.kept, s.k) ELSE l.kept END FROM loop l JOIN steps s ON s.k = l.k + 1 AND s.scope IS NOT DISTINCT FROM l.scope),
ends AS (SELECT scope, arg_max(kept, k) AS kept FROM loop GROUP BY 1),
first AS (SELECT s.scope, s.k, coalesce(list_min(list_intersect(e.kept, s.before)), s.k) AS leader FROM steps s JOIN ends e ON s.scope IS NOT DISTINCT FROM e.scope),
led AS (SELECT x.scope, x.node, y.node AS leader, coalesce(l.jaccard, 1) AS likeness FROM first f JOIN sets x ON x.k = f.k AND x.scope IS NOT DISTINCT FROM f.scope
  JOIN sets y ON y.k = f.leader AND y.scope IS NOT DISTINCT FROM f.scope LEFT JOIN links l ON l.a = f.leader AND l.b = f.k AND l.scope IS NOT DISTINCT FROM f.scope)"""


@query(f"{_walk('SELECT 0 AS scope, doc_id AS node, text FROM documents', 85)} SELECT node AS doc_id, leader, leader = node AS kept, likeness FROM led")
def c04_f07_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Which documents the greedy loop keeps, and which kept one each other is like."""
    found = cl.grouped(t.read(spark, d, "documents").select(F.col("doc_id").alias("node"), "text"))
    return found.select(F.col("node").alias("doc_id"), "leader", (F.col("leader") == F.col("node")).alias("kept"), "likeness")


_LINES = "SELECT doc_id AS scope, i AS node, string_split(text, chr(10))[i] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)"


@query(f"""{_walk(f"SELECT * FROM ({_LINES}) l WHERE NOT contains(text, 'PROTECTED_') QUALIFY count(*) OVER (PARTITION BY scope) >= 5", 85)},
goes AS (SELECT scope, node FROM led WHERE leader <> node), kept AS (SELECT l.scope, string_agg(l.text, chr(10) ORDER BY l.node) AS text, count(g.node) AS removed,
  string_agg(l.text, chr(10) ORDER BY l.node) FILTER (g.node IS NULL) AS rest FROM ({_LINES}) l LEFT JOIN goes g ON l.scope = g.scope AND l.node = g.node GROUP BY 1)
SELECT doc_id, CASE WHEN k.removed > 0 THEN k.rest ELSE d.text END AS text, coalesce(removed, 0) AS removed FROM documents d LEFT JOIN kept k ON d.doc_id = k.scope""")
def f08_repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each document without lines that are near-duplicates of an earlier line that stays."""
    return cl.deduplicated_blocks(t.read(spark, d, "documents"))


_PROMPTS = "SELECT 0 AS scope, conv_id * 1000 + turn AS node, text FROM conversations WHERE role = 'user'"


@query(f"{_walk(_PROMPTS, 75)} SELECT leader, count(*) AS size, CAST(sum(node) AS BIGINT) AS members FROM led GROUP BY 1 HAVING count(*) > 1")
def f11_leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of more than one prompt around the first of them: its number, how many, and the sum of their numbers."""
    c = t.read(spark, d, "conversations").filter("role = 'user'")
    found = cl.grouped(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "text"), 75)
    return found.groupBy("leader").agg(F.count("*").alias("size"), F.sum("node").alias("members")).filter("size > 1")


_BY_SOURCE = "SELECT source AS scope, doc_id AS node, text FROM documents"


@query(f"""{_walk(_BY_SOURCE, 75)},
same AS (SELECT scope, count(*) FILTER (n > 1) AS equal_groups FROM (SELECT source AS scope, count(*) AS n FROM documents GROUP BY source, lower(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')))) x GROUP BY 1),
distinct_sets AS (SELECT scope, min(k) AS k, any_value(s) AS s FROM (SELECT scope, k, s, list_sort(s) AS sorted FROM sets) y GROUP BY scope, sorted),
set_members AS (SELECT scope, k, len(s) AS n, unnest(s) AS g FROM distinct_sets),
near AS (SELECT scope, count(*) AS similar_pairs FROM (SELECT a.scope, a.k, b.k FROM set_members a JOIN set_members b ON a.g = b.g AND a.scope IS NOT DISTINCT FROM b.scope AND a.k < b.k GROUP BY 1, 2, 3
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))) z GROUP BY 1),
around AS (SELECT scope, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS clustered FROM (SELECT scope, leader, count(*) AS n FROM led GROUP BY 1, 2 HAVING count(*) > 1) c GROUP BY 1)
SELECT s.scope AS tenant, equal_groups, coalesce(similar_pairs, 0) AS similar_pairs, coalesce(clusters, 0) AS clusters, coalesce(clustered, 0) AS clustered
FROM same s LEFT JOIN near n ON s.scope IS NOT DISTINCT FROM n.scope LEFT JOIN around a ON s.scope IS NOT DISTINCT FROM a.scope""")
def f18_similarity_report(spark: SparkSession, d: str) -> DataFrame:
    """Equal, similar and clustered texts of each source, over all of its documents."""
    return cl.similarity_report(t.read(spark, d, "documents").select(F.col("source").alias("tenant"), F.col("doc_id").alias("node"), "text"))

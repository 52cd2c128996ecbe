"""Merkle manifest of a dataset: leaves by source, subroots, one root, and for every row its audit path, folded and checked.

Rows get their place among their source's leaves by a range exchange of digests. Each aligned block of 3^7 leaves is then walked leaf by
leaf as in Merkle tree traversal: per level the run of siblings around the present leaf is kept, and a treehash stack works ahead
on the level's next run, one leaf a step. The blocks' roots are leaves of the next round, up to one root, and each
round's paths are appended to those of the blocks below. Texts are read once, by the leaf digests; only digests are exchanged.

Defined cases: a null field counts as ``-``; a null doc_id comes first in its source and is never tampered with; rows of equal doc_id are ordered by
their leaf, and equal rows have equal leaves, each with a path of its own; a null source is a source, the first one; empty and
very long texts are leaves as any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, documents, materialize

ARITY, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])


def digest_of(*fields: Column) -> Column:
    """Leaf digest: each field as its length in bytes, a colon and its value, or - where it is null."""
    shown = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (x.cast("string") for x in fields)]
    return F.sha2(F.concat(*shown), 256)


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Treehash:
    """Works out the nodes of ``level`` over leaves[start:stop], one leaf an update, with a stack of runs that are not yet full."""

    def __init__(self, leaves: list[str], level: int, start: int, stop: int, arity: int = ARITY):
        self.leaves, self.level, self.next, self.stop, self.arity = leaves, level, start, stop, arity
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]  # of each level, at most arity nodes

    def update(self) -> None:
        if self.next < self.stop:
            self.runs[0].append(self.leaves[self.next])
            self.next += 1
            for level in range(self.level):
                if len(self.runs[level]) == self.arity or self.next == self.stop and self.runs[level]:
                    self.runs[level + 1].append(parent(self.runs[level]))
                    self.runs[level] = []

    def lowest(self) -> int:
        """The level of the lowest node on the stack, the own level of an empty one; beyond all levels once there is nothing to do."""
        if self.next >= self.stop:
            return len(self.leaves)
        return next((level for level in range(self.level) if self.runs[level]), self.level)

    def finish(self) -> list[str]:
        while self.next < self.stop:
            self.update()
        return self.runs[self.level]


def traverse(leaves: list[str], height: int, arity: int = ARITY):
    """For each leaf in order, its run and its place in it for each of ``height`` levels. A step has an update for each level, and
    each goes to the stack with the lowest node, so that besides a run of each level there is hardly more than one stack's content."""
    n, widths = len(leaves), [arity**h for h in range(height + 1)]
    runs = [Treehash(leaves, h, 0, min(n, widths[h + 1]), arity).finish() for h in range(height)]
    ahead = [Treehash(leaves, h, widths[h + 1], min(n, 2 * widths[h + 1]), arity) for h in range(height)]
    for i in range(n):
        yield [(runs[h], i // widths[h] % arity) for h in range(height)]
        for _ in range(height):
            min(ahead, key=Treehash.lowest).update()
        for h in range(height):
            if (i + 1) % widths[h + 1] == 0:
                runs[h] = ahead[h].finish()
                at = i + 1 + widths[h + 1]
                ahead[h] = Treehash(leaves, h, min(n, at), min(n, at + widths[h + 1]), arity)


def height_of(n: int, arity: int = ARITY) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // arity), height + 1
    return height


def placed(nodes: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """nodes with ``place``, their rank by order among those of equal ``tree`` values, and ``size``, how many those are. No node is
    ranked by one task with all others: ranges are numbered in themselves, and a small table has each range's first place."""
    by = [F.col(c).asc_nulls_first() for c in (*tree, *order)]
    ranged = nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id())
    ranged = materialize(ranged, "merkle-places").withColumn("part", F.shiftright("row", 33))
    parts = materialize(ranged.groupBy("part", *tree).agg(F.min("row").alias("first"), F.count("*").alias("n")), "merkle-parts")
    spread = Window.partitionBy(*[F.col(c) for c in tree])
    before = F.sum("n").over(spread.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("part", *[F.col(c).alias(f"_{c}") for c in tree], (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(spread).alias("size"))
    same = [ranged["part"] == starts["part"], *[ranged[c].eqNullSafe(starts[f"_{c}"]) for c in tree]]
    joined = ranged.join(broadcast_if_small(starts, parts.count()), same)
    return joined.select(*nodes.columns, (F.col("row") + F.col("shift")).alias("place"), "size")


def _keys(tree: list[str], height: int) -> list[Column]:
    return [*[F.col(c) for c in tree], F.floor(F.col("place") / ARITY**height).alias("block")]


def _levels(size: int, height: int) -> int:
    """Levels within a block: all of them where the tree has further blocks, else up to its one node."""
    return height if size > ARITY**height else height_of(size)


def block_roots(nodes: DataFrame, tree: list[str], height: int = HEIGHT) -> DataFrame:
    """The root of each aligned block: tree, place (its rank among the tree's blocks), size (their number) and digest."""
    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        size = int(rows["size"].iloc[0])
        found = Treehash(rows["digest"].tolist(), _levels(size, height), 0, len(rows)).finish()[0]
        out = rows.iloc[:1][[*tree]].copy()
        return out.assign(place=int(rows["place"].iloc[0]) // ARITY**height, size=-(-size // ARITY**height), digest=found)

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in tree], "place long", "size long", "digest string"])
    return nodes.select(*tree, "place", "size", "digest").groupBy(*_keys(tree, height)).applyInPandas(root, schema)


def with_paths(nodes: DataFrame, tree: list[str], extra: list[str], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """nodes' tree, place, digest and extra columns with ``path``, an array of what stands before and after the node's ancestor in its run, level by level:
    within the block, then the path of the block's root, from ``above`` (tree, block, path)."""
    columns = [*tree, "place", "digest", *extra]

    def walk(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*columns, "path"])
        rows = rows.sort_values("place")
        shared = [dict(zip(("before", "after"), x)) for x in upper["path"].iloc[0].tolist()] if len(upper) else []
        paths = []
        for steps in traverse(rows["digest"].tolist(), _levels(int(rows["size"].iloc[0]), height)):
            paths.append([{"before": "".join(run[:at]), "after": "".join(run[at + 1 :])} for run, at in steps] + shared)
        return rows[columns].assign(path=paths)

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in columns], "path array<struct<before:string,after:string>>"])
    steps = F.transform("path", lambda s: F.array(s["before"], s["after"]))  # pandas gets plain arrays
    below = nodes.select(*columns, "size").groupBy(*_keys(tree, height))
    return below.cogroup(above.select(*tree, "block", steps.alias("path")).groupBy(*tree, "block")).applyInPandas(walk, schema)


def audit_paths(nodes: DataFrame, tree: list[str], extra: list[str], height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, place, size, digest, extra) with their paths up to their tree's root, and the roots (tree, digest)."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    roots = materialize(block_roots(nodes, tree, height), "merkle-blocks")
    kinds = {f.name: f.dataType for f in nodes.schema}
    if most > ARITY**height:
        upper, top = audit_paths(roots, tree, [], height)
        above = upper.select(*tree, F.col("place").alias("block"), "path")
    else:
        schema = T.StructType([*[T.StructField(c, kinds[c]) for c in tree], T.StructField("block", T.LongType()), T.StructField("path", T.ArrayType(STEP))])
        above, top = nodes.sparkSession.createDataFrame([], schema), roots.select(*tree, "digest")
    return with_paths(nodes, tree, extra, above, height), top


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    fields = {c: F.col(c) for c in FIELDS}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", digest_of(*fields.values()).alias("digest"), digest_of(*(fields | {"text": tampered}).values()).alias("tampered"))
    leaves = placed(leaves, ["source"], ["doc_id", "digest"])
    below, subroots = audit_paths(leaves, ["source"], ["doc_id", "tampered"], height)
    subroots = materialize(subroots, "merkle-subroots")
    sources = placed(subroots.withColumn("tree", F.lit(0)), ["tree"], ["source"])
    upper, root = audit_paths(sources, ["tree"], ["source"], height)
    upper = upper.crossJoin(F.broadcast(root.select(F.col("digest").alias("root")))).select(F.col("source").alias("_source"), F.col("digest").alias("subroot"), "root", F.col("path").alias("shared"))  # root: one row
    upper = materialize(upper, "merkle-upper")
    rows = below.join(broadcast_if_small(upper, upper.count()), F.col("source").eqNullSafe(F.col("_source")))
    path = F.concat("path", "shared")
    proof = F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)
    found = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(F.col("tampered"), path).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


_STEP = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"


def _crc_table() -> str:
    """SQL of the list of the 256 CRC-32 remainders of one byte."""
    x = "CAST(i AS BIGINT)"
    for k in range(8):
        x = f"(SELECT {_STEP.format(x='v')} FROM (SELECT {x} AS v))"
    return f"SELECT list({x} ORDER BY i) AS remainders FROM range(256) AS bytes(i)"


OP12_SQL = f"""
WITH RECURSIVE crc AS ({_crc_table()}),
keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda acc, c: xor(acc >> 8, remainders[CAST(xor(acc, c) & 255 AS INT) + 1])), 4294967295) AS crc
  FROM documents, crc),
fields AS (
  SELECT doc_id, source, text,
    concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM keyed),
digests AS (
  SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    sha256(concat(head, CASE WHEN changed IS NULL THEN '-' ELSE concat(strlen(changed), ':', changed) END)) AS tampered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM digests),
lower_nodes AS (
  SELECT source, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM lower_nodes WHERE n > 1 GROUP BY source, level, place // 3, n),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM lower_nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM upper_nodes WHERE n > 1 GROUP BY level, place // 3, n),
lower_runs AS (SELECT source, level, place // 3 AS run, list(digest ORDER BY place) AS digests FROM lower_nodes WHERE n > 1 GROUP BY source, level, place // 3),
upper_runs AS (SELECT level, place // 3 AS run, list(digest ORDER BY place) AS digests FROM upper_nodes WHERE n > 1 GROUP BY level, place // 3),
walk AS (
  SELECT l.source, l.doc_id, l.leaf, s.subroot, l.place, s.place AS upper_place, l.n, s.n AS upper_n, 0 AS level, 0 AS upper_level, l.tampered AS folded, '' AS siblings
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT w.source, w.doc_id, w.leaf, w.subroot, CASE WHEN w.n > 1 THEN w.place // 3 ELSE 0 END, CASE WHEN w.n > 1 THEN w.upper_place ELSE w.upper_place // 3 END,
    CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE 1 END, CASE WHEN w.n > 1 THEN w.upper_n ELSE (w.upper_n + 2) // 3 END,
    w.level + CAST(w.n > 1 AS INT), w.upper_level + CAST(w.n <= 1 AS INT),
    sha256(concat(array_to_string(r.digests[: r.spot], ''), w.folded, array_to_string(r.digests[r.spot + 2 :], ''))),
    concat(w.siblings, array_to_string(r.digests[: r.spot], ''), array_to_string(r.digests[r.spot + 2 :], ''))
  FROM (SELECT *, CASE WHEN n > 1 THEN place % 3 ELSE upper_place % 3 END AS spot FROM walk WHERE n > 1 OR upper_n > 1) w
  JOIN (SELECT source, level, run, digests, true AS low, spot FROM lower_runs, range(3) AS p(spot)
        UNION ALL SELECT NULL, level, run, digests, false, spot FROM upper_runs, range(3) AS p(spot)) r
    ON r.low = (w.n > 1) AND r.spot = w.spot AND (NOT r.low OR r.source IS NOT DISTINCT FROM w.source)
    AND r.level = CASE WHEN w.n > 1 THEN w.level ELSE w.upper_level END AND r.run = CASE WHEN w.n > 1 THEN w.place // 3 ELSE w.upper_place // 3 END)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk, (SELECT digest AS root FROM upper_nodes WHERE n = 1) WHERE walk.n = 1 AND walk.upper_n = 1
"""

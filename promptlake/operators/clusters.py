"""Greedy selection among similar texts: near-duplicate elimination and leader clusters, as rounds of joins.

The greedy loop takes texts in order; one that is like an earlier one that was taken goes, and belongs to the first such; any other is taken.
What is taken is the lexicographically first maximal independent set of the similarity graph, so that a text is decided as soon as
all its earlier neighbours are: each round takes all texts without an undecided earlier neighbour and drops theirs. There are as
many rounds as the longest chain of decisions that wait for each other, few for graphs of near-duplicates; nothing bounds it
(the problem is P-complete), and each round's work is that of the edges still undecided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import text as tx
from .language import set_key, set_pairs


def dropped(links: DataFrame) -> tuple[DataFrame, int]:
    """The nodes of links (a, b), a < b, that the greedy loop drops, and the number of rounds."""
    edges = written(links.select("a", "b").distinct(), "undecided")
    found, rounds = edges.select(F.col("b").alias("node")).limit(0), 0
    while not edges.isEmpty():
        rounds += 1
        taken = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = written(edges.join(taken, "a").select(F.col("b").alias("node")).distinct(), "dropped")
        found = found.unionByName(gone)
        for side in "ab":
            edges = edges.join(gone.withColumnRenamed("node", side), side, "left_anti")
        edges = written(edges.select("a", "b"), "undecided")
    return found, rounds


def leaders(links: DataFrame) -> tuple[DataFrame, int]:
    """node and leader (the first taken neighbour) of each dropped node, with the link's likeness; and the number of rounds. links: a, b, jaccard."""
    gone, rounds = dropped(links)
    gone = written(gone, "dropped-nodes")
    taken = links.join(gone.withColumnRenamed("node", "a"), "a", "left_anti")
    first = F.min(F.struct("a", "jaccard"))
    found = taken.groupBy(F.col("b").alias("node")).agg(first.alias("x")).select("node", F.col("x.a").alias("leader"), F.col("x.jaccard").alias("likeness"))
    return found, rounds


def grouped(texts: DataFrame, percent: int = 85, k: int = 3, scope: Column | None = None) -> DataFrame:
    """texts (node, text) with each text's leader: itself where the greedy loop in order of node takes it, else the first taken text whose
    k-word shingles agree by percent at least, and their ``likeness``. Only texts of equal scope meet.

    Equal sets are represented by their first text, which decides for all: a later one is like it, or has its leader. Null texts
    count as empty, and empty texts are alike.
    """
    return _led(*linked(texts, percent, k, scope))


def linked(texts: DataFrame, percent: int, k: int = 3, scope: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The sets of shingles of texts (node, text), and the pairs of different ones of equal scope that agree by percent; both as tables."""
    sets = texts.select("node", tx.hashed_shingles(F.col("text"), k, F.lit(0) if scope is None else scope).alias("s"))
    sets = written(sets.select("node", "s", set_key(F.col("s")).alias("key")), "shingle-sets")
    return sets, written(set_pairs(sets, percent), "similar-sets")


def _led(sets: DataFrame, links: DataFrame) -> DataFrame:
    """node, leader and likeness of each of the sets by the links of the first ones of equal sets."""
    found, _ = leaders(links)
    first = sets.groupBy("key").agg(F.min("node").alias("first"))
    led = first.join(found.withColumnRenamed("node", "first"), "first", "left")
    return sets.select("node", "key").join(led, "key").select("node", F.coalesce("leader", "first").alias("leader"), F.coalesce("likeness", F.lit(1.0)).alias("likeness"))


def deduplicated_blocks(docs: DataFrame, separator: str = "\n", percent: int = 85, least: int = 5) -> DataFrame:
    """doc_id, the text without blocks that are near-duplicates of an earlier one that stays (in the same text, in order), and how many went.

    Blocks that hold PROTECTED_ stay and are compared with none; a text with fewer than ``least`` blocks, or as many
    besides those, stays as it is.
    """
    all_, fixed = F.split("text", separator, -1), lambda x: F.contains(x, F.lit("PROTECTED_"))
    many = docs.filter(F.size(F.filter(all_, lambda x: ~fixed(x))) >= least)
    open_ = many.select("doc_id", F.posexplode(all_).alias("position", "block")).filter(~fixed(F.col("block")))
    found = grouped(open_.select(F.struct("doc_id", "position").alias("node"), F.col("block").alias("text"), "doc_id"), percent, scope=F.col("doc_id"))
    goes = found.filter("leader <> node").select("node.doc_id", "node.position").groupBy("doc_id").agg(F.collect_set("position").alias("goes"))
    joined = docs.select("doc_id", "text").join(goes, "doc_id", "left").withColumn("goes", F.coalesce("goes", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", separator, -1), lambda x, i: ~F.array_contains("goes", i))
    return joined.select("doc_id", F.when(F.size("goes") > 0, F.array_join(kept, separator)).otherwise(F.col("text")).alias("text"), F.size("goes").cast("long").alias("removed"))


def similarity_report(prompts: DataFrame, percent: int = 85, cluster_percent: int = 75) -> DataFrame:
    """Per tenant of prompts (tenant, node, text): groups of equal texts (lower-cased, white space collapsed), pairs of similar different
    shingle sets, clusters of more than one prompt around a leader, and the prompts in those."""
    same = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    equal = prompts.groupBy("tenant", F.sha2(same, 256).alias("key")).agg(F.count("*").alias("n")).groupBy("tenant").agg(F.count_if(F.col("n") > 1).alias("equal_groups"))
    nodes = prompts.select(F.struct("tenant", "node").alias("node"), "text", "tenant")
    sets, links = linked(nodes, min(percent, cluster_percent), scope=F.col("tenant"))
    least = lambda p: links.filter(f"100 * n >= {p} * union")
    pairs = least(percent).groupBy("a.tenant").agg(F.count("*").alias("similar_pairs"))
    led = _led(sets, least(cluster_percent)).groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1")
    clusters = led.groupBy("leader.tenant").agg(F.count("*").alias("clusters"), F.sum("n").alias("clustered"))
    found = equal.join(pairs, equal["tenant"].eqNullSafe(pairs["tenant"]), "left").drop(pairs["tenant"])
    found = found.join(clusters, found["tenant"].eqNullSafe(clusters["tenant"]), "left").drop(clusters["tenant"])
    return found.select("tenant", "equal_groups", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("similar_pairs", "clusters", "clustered")])

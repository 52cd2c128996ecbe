"""Exact Jaccard self-join on word n-grams, by universe partition and the pigeonhole principle.

A text's set holds the 64-bit hashes of its distinct word n-grams (exact up to collisions of these). Two sets of sizes
s <= r that link differ in at most H = (r + s)(1 - t) / (1 + t) members, which bounds r by s / t; sizes are cut into bands
so narrow that a partner lies in the same band or the next. In each band the hash universe is cut into m = H + 1 segments,
so that linked sets have the same members in at least one segment: (band, segment, members) is a signature, and texts that
share none cannot link. Costs decide what a text spends on a segment: one signature as a rule; a segment without members
tells nothing and gets none, and the next segment gets its one-deletion neighbourhood instead, under signatures that
name both. That loses nothing: the numbers of members in which a linked pair differs in the segments sum to at most m - 1, so by
the cycle lemma there is a segment i without a difference after which segment i + 1 has at most one.

Within a signature's group no pairs are listed. Equal sets count once. Each member is verified against the group's pivot, the
member that shares most signatures with other texts, and links give components. A member that misses may still link with
another: distances obey the triangle inequality, so one further than twice a link's distance from the pivot can only link
with other members that miss. Those, and all members where one comes nearer, stay open if they are of different components.
Most candidate pairs are far apart, and whole sets are large: sketches meet first (``_possible``), a byte for each of about as many cells as a
set has members. Sets that differ in d members differ in at most d cells, so what differs in more cells than a pair may is no such pair.

Open texts share a passage or are many edits of one text, and are refined (``_refine``): the rarest members of their sets (prefix
filtering; linked sets share one of them) part most. Texts that still meet under more than ``few`` of them form a cluster with
a reference set C, the members that most of its texts have. With D(x) = x xor C and k(x) = |D(x)| - |x|(1 - t) / (1 + t), two texts
link exactly if they share at least (k(x) + k(y)) / 2 members of D(x) and D(y). Where that is not above 0 for a pair, it is not
for either with the text y0 of least k, so that verifying all against y0 finds what links without a shared member, and prefix
filtering of D(x) the rest. What the cluster has in common is in no D(x), so the groups that are left are small; those that
are not are clusters of the next round, and after ``rounds`` rounds their pairs are listed, so that no link is lost.

Defined cases: null and blank texts have no n-grams and link with nothing; texts of fewer than n words have one, their
whole sequence; rows that share a doc_id are one document, which links where one of its texts does, and a row without doc_id
has the answer of the texts that it equals; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import broadcast_if_small, discard, documents, materialize, release_shuffles
from .components import connected_components

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Signatures that a bucket is meant for, texts dealt out at a time.
BUCKET, SLICE = 2_000_000, 2_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of the text's words, ASCII letters in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(hashes))
    rows = len(hashes) - n + 1
    grams = np.full(rows, n, np.uint64)
    for k in range(n):
        grams = _mix(grams * _C + hashes[k : k + rows])
    return np.unique(grams)


@lru_cache(64)
def _bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest size of each band up to a band that holds ``largest``, and the band's number of segments."""
    tops, segments, low = [], [], 1
    while not tops or tops[-1] < largest:
        top = low * 100 // percent
        tops.append(top)
        segments.append((top + top * 100 // percent) * (100 - percent) // (100 + percent) + 1)
        low = top + 1
    return np.array(tops), np.array(segments)


def _segments(grams: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each band that the set has signatures in: band, m, members' segments, members' hashes, segments' sums."""
    size = len(grams)
    tops, counts = _bands(percent, 1 << max(10, size.bit_length()))
    band = int(np.searchsorted(tops, size))
    inner, values = _mix(grams + _B), _mix(grams + _C)
    for b in (band, band - 1):
        if b == band or b >= 0 and 100 * int(tops[b]) >= percent * size:
            m = int(counts[b])
            at = (inner % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, at, values)
            yield b, m, at, values, sums


def _neighbourhood(tag: np.ndarray, j: int, at: np.ndarray, values: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Signatures of segment j's members and of what one deletion leaves of them, all under the tag."""
    return _mix(np.concatenate(([sums[j]], sums[j] - values[at == j])) * _A + _mix(tag + np.uint64(j + 1)))


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    found = []
    for b, m, at, values, sums in _segments(grams, percent):
        own = _mix(sums * _A + _mix(np.uint64(b << 32) + np.arange(m, dtype=np.uint64)))
        bare = np.bincount(at, minlength=m) == 0
        found.append(own[~bare])
        found += [_neighbourhood(own[i : i + 1] + _C, (i + 1) % m, at, values, sums) for i in np.flatnonzero(bare)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _sign(docs: DataFrame, n: int, percent: int, kind: str) -> DataFrame:
    """n_shingles, digest, signatures and their number of every row; of equal sets in one batch only the first has signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: set[bytes] = set()
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, digests, found = [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    grams = ngram_set(text, n)
                    digest = xxh3_128_digest(grams.tobytes())
                    sizes.append(len(grams))
                    digests.append(digest)
                    signs = doc_id is not None and len(grams) and digest not in seen
                    found.append(signatures(grams, percent) if signs else grams[:0])
                    if signs:
                        seen.add(digest)
                edges = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32())
                sigs = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(found).view(np.int64)))
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sigs, pa.array(map(len, found), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sigs", "n_sigs"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sigs array<long>, n_sigs long")


def _shared_signatures(signed: DataFrame, buckets: int, kind: str, counted: bool = False) -> DataFrame:
    """sig and doc_id wherever more than one row of signed (doc_id, sigs) has the signature, counted: and n, how many have it. Signatures are dealt out once, by their hash and as
    arrays with the texts that they are of, so that what no other text has goes no further than its bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda edges, values: pa.ListArray.from_arrays(pa.array(np.append(edges, len(values)), pa.int32()), values)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                sigs = batch.column(1).flatten().to_numpy().view(np.uint64)
                at = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                if not len(sigs):
                    continue
                bucket = _mix(sigs) % np.uint64(buckets)
                order = np.lexsort((at, bucket))
                sigs, at, bucket = sigs[order], at[order], bucket[order]
                runs = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (bucket[1:] != bucket[:-1])])
                first = np.flatnonzero(np.r_[True, bucket[runs][1:] != bucket[runs][:-1]])
                sizes = pa.array(np.diff(np.append(runs, len(sigs))).astype(np.int32))
                arrays = [of(first, batch.column(0).take(pa.array(at[runs]))), of(first, sizes), of(runs[first], pa.array(sigs.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[runs[first]].astype(np.int64)), *arrays], names=["bucket", "ids", "sizes", "sigs"])

    def meet(group: pa.Table) -> pa.Table:
        flat = lambda c: group.column(c).combine_chunks().flatten()
        ids, sizes, sigs = flat("ids"), flat("sizes").to_numpy(), flat("sigs").to_numpy()
        order = np.argsort(sigs, kind="stable")
        ordered = sigs[order]
        same = ordered[1:] == ordered[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        at = np.repeat(np.arange(len(sizes)), sizes)[order]
        found = {"sig": sigs[order], "doc_id": ids.take(pa.array(at))}
        if counted:
            _, of, counts = np.unique(sigs[order], return_inverse=True, return_counts=True)
            found["n"] = counts[of].astype(np.int64)
        return pa.table(found)

    dealt = signed.filter("doc_id is not null").select("doc_id", "sigs").mapInArrow(deal, f"bucket long, ids array<{kind}>, sizes array<int>, sigs array<long>")
    return dealt.groupBy("bucket").applyInArrow(meet, f"sig long, doc_id {kind}" + ", n long" * counted)


def _grams(docs: DataFrame, n: int, kind: str) -> DataFrame:
    """node (the doc_id) and its set as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_set(x, n).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    return docs.mapInArrow(run, f"node {kind}, grams array<long>")


def sketch(grams: np.ndarray) -> np.ndarray:
    """Cells of the hash universe, a power of two and at least three quarters of the members: a byte each, the sum over its members."""
    cells = 8
    while 4 * cells < 3 * len(grams):
        cells *= 2
    mixed = _mix(grams + _A)
    return np.bincount((mixed % np.uint64(cells)).astype(np.int64), (mixed >> np.uint64(56)).astype(np.int64), cells).astype(np.int64).astype(np.uint8)


def differing_cells(a: np.ndarray, b: np.ndarray) -> int:
    """In how many cells two sketches differ, the finer one folded: never more than the sets differ in members."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.count_nonzero(a.reshape(-1, len(b)).sum(0, dtype=np.uint8) != b))


def _sketches(rows: DataFrame, set_of, kind: str) -> DataFrame:
    """node, the size of its set and the set's sketch, from rows of a node and what set_of makes a set of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_of(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "sketch"])

    return rows.mapInArrow(run, f"node {kind}, size long, sketch binary")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with ``possible``: false only where no texts of theirs are alike by percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column(2).to_numpy()
            cells = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(k)] for k in (3, 4)]
            differ = np.fromiter(map(differing_cells, *cells), np.int64, len(sums))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((100 + percent) * differ <= (100 - percent) * sums)], names=["a", "b", "possible"])

    kind = sketches.schema["node"].dataType.simpleString()
    sides = [sketches.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    met = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sum"), "sketch_a", "sketch_b")
    return met.mapInArrow(run, f"a {kind}, b {kind}, possible boolean").groupBy("a", "b").agg(F.max("possible").alias("possible"))


def verify(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with ``link``, and ``near``: whether they lie within twice a link's distance."""
    sides = [grams.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab"]
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    found = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", both.alias("both"), (F.size("grams_a") + F.size("grams_b")).alias("sum"))
    holds = lambda p: 100 * F.col("both") >= p * (F.col("sum") - F.col("both"))
    return found.groupBy("a", "b").agg(F.max(holds(percent)).alias("link"), F.max(holds(2 * percent - 100)).alias("near"))


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


class _Links:
    """Links found so far, as components: the least node of each. ``grams`` are the sets of the nodes; where they are not held, ``sets``
    makes those of some nodes, and sketches are given."""

    def __init__(self, grams: DataFrame | None, percent: int, sketches: DataFrame | None = None, sets=None):
        self.grams, self.percent, self.labels, self.sets = grams, percent, None, sets
        if sketches is None:
            kind = grams.schema["node"].dataType.simpleString()
            sketches = materialize(_sketches(grams.select("node", "grams"), lambda x: np.array(x, np.int64).view(np.uint64), kind), "sketches")
        self.sketches = sketches

    def check(self, pairs: DataFrame, near: bool = False) -> DataFrame:
        """The pairs with ``link`` and, where asked for, ``near``, written; what links is taken up into the components."""
        least = 2 * self.percent - 100 if near else self.percent
        seen = materialize(_possible(pairs, self.sketches, least), "possible-pairs")
        release_shuffles(pairs.sparkSession)
        some = seen.filter("possible").select("a", "b")
        if self.grams is None:
            grams = self.sets(_ends(some), "grams")
            release_shuffles(pairs.sparkSession)
        else:
            grams = self.of_nodes(_ends(some))
        far = seen.filter("not possible").select("a", "b", F.lit(False).alias("link"), F.lit(False).alias("near"))
        found = materialize(verify(some, grams, self.percent).unionByName(far), "verified")
        discard(seen, *([grams] if self.grams is None else []))
        links = found.filter("link").select("a", "b")
        if self.labels is None:
            self.labels = materialize(connected_components(links), "components")
            return found
        # links between components are few: these are joined, not the texts again
        ends = links.withColumnRenamed("a", "node")
        ends = self.of(ends).select(F.col("component").alias("a"), F.col("b").alias("node"))
        across = materialize(self.of(ends).select("a", F.col("component").alias("b")).filter("a <> b").distinct(), "links-across")
        if not across.isEmpty():
            joined = materialize(connected_components(across), "joined-components")
            before, new = self.labels, joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
            labels = before.join(new, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
            alone = joined.join(before, "node", "left_anti")
            self.labels = materialize(labels.unionByName(alone.select("node", "component")), "components")
            discard(before, joined)
        return found

    def of_nodes(self, rows: DataFrame) -> DataFrame:
        """The sets held of the nodes in rows (node, distinct); these go to the sets where they are few, so that only their sets are exchanged."""
        return self.grams.join(broadcast_if_small(rows.select("node"), rows.count()), "node", "left_semi")

    def of(self, rows: DataFrame) -> DataFrame:
        """rows (node, ...) with the node's component."""
        return rows.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _parted(rows: DataFrame, *keys: str) -> DataFrame:
    """Those of rows (keys, node, component) whose keys hold more than one component, with the number of rows as ``size``."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(groups.filter("low <> high").select(*keys, "size"), list(keys))


def _pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """Pairs of nodes of different components with equal keys; not of two texts on the side of the cluster's core."""
    left = rows.select(*keys, F.col("node").alias("a"), F.col("component").alias("c"), F.col("core").alias("core_a"))
    right = rows.select(*keys, F.col("node").alias("b"), F.col("component").alias("d"), F.col("core").alias("core_b"))
    return left.join(right, list(keys)).filter("a < b and c <> d and (not meets_core or core_a <> core_b)").select("a", "b").distinct()


def _shared_members(rows: DataFrame) -> DataFrame:
    """cluster, node and ``shared``: those members of rows (cluster, node, members) that more than one row of the cluster has, with n, the rarest first."""
    members = rows.select("cluster", "node", F.explode("members").alias("member"))
    often = members.groupBy("cluster", "member").agg(F.count("*").alias("n")).filter("n > 1")
    return members.join(often, ["cluster", "member"]).groupBy("cluster", "node").agg(F.sort_array(F.collect_list(F.struct("n", "member"))).alias("shared"))


def _shared_of_all(grams: DataFrame) -> DataFrame:
    """The same for all of grams as one cluster, 0: members are dealt out once, as arrays, and only shared ones go on."""
    buckets = 12 + (grams.agg(F.sum(F.size("grams"))).first()[0] or 0) // BUCKET
    met = _shared_signatures(grams.select(F.col("node").alias("doc_id"), F.col("grams").alias("sigs")), buckets, grams.schema["node"].dataType.simpleString(), counted=True)
    met = materialize(met, "shared-members")
    release_shuffles(grams.sparkSession)
    met = met.select(F.lit(0).alias("cluster"), F.col("doc_id").alias("node"), "n", F.col("sig").alias("member"))
    return met.groupBy("cluster", "node").agg(F.sort_array(F.collect_list(F.struct("n", "member"))).alias("shared"))


def _prefixes(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (cluster, node, component, core, and whom to meet: need, or need_core for pairs of a core text and another), with what they share, as
    (cluster, meets_core, member, node, component, core): of each text its rarest members, so many that any pair that shares as
    many as needed shares one of these."""
    # those that no other text has come first, and part nothing
    length = lambda need: F.greatest(F.lit(0), F.size("shared") - F.col(need) + 1)
    kinds = F.array(*[F.struct(F.lit(meets).alias("meets_core"), F.slice("shared", 1, length(need)).alias("first")) for meets, need in ((False, "need"), (True, "need_core"))])
    out = rows.join(shared, ["cluster", "node"]).withColumn("kind", F.explode(kinds))
    out = out.filter("(core and kind.meets_core and need_core is not null) or (not core and (not kind.meets_core or need_core is not null))")
    return out.select("cluster", F.col("kind.meets_core").alias("meets_core"), F.explode("kind.first.member").alias("member"), "node", "component", "core")


def _around_references(clusters: DataFrame, links: _Links, percent: int) -> DataFrame:
    """clusters (node, cluster) as rows for _prefixes, after all texts are verified against the one that is least from the
    cluster's reference set; without clusters that this leaves with one component."""
    rows = clusters.join(links.of_nodes(clusters), "node")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("texts"))
    often = rows.select("cluster", F.explode("grams").alias("member")).groupBy("cluster", "member").agg(F.count("*").alias("n"))
    # at most twice as many members as the cluster's texts have on average
    reference = often.join(sizes, "cluster").filter("2 * n > texts").groupBy("cluster").agg(F.collect_list("member").alias("reference"))
    rows = rows.join(reference, "cluster", "left").withColumn("reference", F.coalesce("reference", F.array().cast("array<long>")))
    members = F.concat(F.array_except("grams", "reference"), F.array_except("reference", "grams"))
    rows = rows.select("cluster", "node", F.size("grams").alias("size"), members.alias("members"))
    rows = materialize(rows.withColumn("k", (100 + percent) * F.size("members") - (100 - percent) * F.col("size")), "around-references")
    least = rows.groupBy("cluster").agg(F.min(F.struct("k", "node")).alias("least"))
    links.check(clusters.join(least, "cluster").select(F.col("node").alias("a"), F.col("least.node").alias("b")).filter("a <> b"))
    rows = links.of(rows)
    at = links.of(least.select("cluster", F.col("least.k").alias("k_least"), F.col("least.node").alias("node"))).select("cluster", "k_least", F.col("component").alias("core_component"))
    rows = rows.join(at, "cluster").withColumn("core", F.col("component") == F.col("core_component"))
    others = rows.filter("not core").groupBy("cluster").agg(F.min("k").alias("k_other"))
    rows = rows.join(others, "cluster")
    # how many members a pair shares at least if it links
    share = lambda k: F.greatest(F.lit(1), F.ceil((F.col("k") + F.col(k)) / (2 * (100 + percent)))).cast("int")
    return rows.select("cluster", "node", "component", "core", "members", share("k_other").alias("need"), F.when(F.col("core"), share("k_other")).otherwise(share("k_least")).alias("need_core"))


def _refine(nodes: DataFrame, links: _Links, percent: int, few: int, rounds: int) -> None:
    """Adds all links between nodes of different components."""
    keys = ["cluster", "meets_core", "member"]
    sizes = materialize(links.grams.select("node", F.size("grams").alias("size")), "open-sizes")
    rows = links.of(sizes).select(
        F.lit(0).alias("cluster"), "node", "component", F.lit(False).alias("core"),
        F.ceil(F.col("size") * percent / F.lit(100)).cast("int").alias("need"), F.lit(None).cast("int").alias("need_core"),
    )
    shared = _shared_of_all(links.grams)
    for last in (*[False] * rounds, True):
        reached = materialize(_prefixes(rows, shared), "prefix-members")
        release_shuffles(nodes.sparkSession)
        open_ = materialize(_parted(reached, *keys), "prefixes")
        discard(reached)
        links.check(_pairs(open_ if last else open_.filter(F.col("size") <= few), *keys))
        release_shuffles(nodes.sparkSession)
        if last:
            return
        left = links.of(open_.filter(F.col("size") > few).drop("component", "size"))
        left = materialize(_parted(left, *keys), "open-prefixes")
        if left.isEmpty():
            return
        hub = left.groupBy(*keys).agg(F.min("node").alias("b"))
        clusters = connected_components(left.join(hub, keys).select(F.col("node").alias("a"), "b").distinct())
        clusters = materialize(clusters.withColumnRenamed("component", "cluster"), "clusters")
        rows = materialize(_around_references(clusters, links, percent), "open-clusters")
        rows, shared = rows.drop("members"), _shared_members(rows)
        discard(open_, left)
        release_shuffles(nodes.sparkSession)


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, few: int = 16, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links of at least percent / 100 reach) per row of docs."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(_sign(docs, n, percent, kind), "signatures")
    sets = materialize(signed.select("doc_id", "n_shingles", "digest"), "sets")
    first = materialize(sets.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first")), "first-of-set")

    buckets = 12 + (signed.agg(F.sum("n_sigs")).first()[0] or 0) // BUCKET
    shared = materialize(_shared_signatures(signed, buckets, kind), "shared-signatures")
    discard(signed)
    release_shuffles(docs.sparkSession)
    stands = sets.join(first, "digest").groupBy("doc_id").agg(F.min("first").alias("node"))
    members = materialize(shared.join(stands, "doc_id").select("sig", "node").distinct(), "members")
    discard(shared)
    release_shuffles(docs.sparkSession)
    sizes = members.groupBy("sig").agg(F.count("*").alias("size")).filter("size > 1")
    sized = members.join(sizes, "sig")
    degrees = sized.groupBy("node").agg(F.sum("size").alias("degree"))
    pivots = sized.join(degrees, "node").groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("pivot"))
    stars = sized.join(pivots, "sig").select("sig", F.col("node").alias("a"), F.col("pivot.node").alias("b")).filter("a <> b")
    stars = materialize(stars, "signature-stars")
    release_shuffles(docs.sparkSession)
    pairs = stars.select("a", "b").distinct()

    def texts(nodes: DataFrame) -> DataFrame:
        return docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").distinct()

    sketches = materialize(_sketches(texts(_ends(pairs)), lambda x: ngram_set(x, n), kind), "sketches")
    links = _Links(None, percent, sketches, lambda nodes, name: materialize(_grams(texts(nodes), n, kind), name))
    release_shuffles(docs.sparkSession)
    missed = stars.join(links.check(pairs, near=True).filter("not link").drop("link"), ["a", "b"])
    missed = materialize(missed, "missed-members")
    whole = stars.join(missed.filter("near").select("sig").distinct(), "sig", "left_semi")
    open_ = missed.select("sig", F.col("a").alias("node")).unionByName(whole.select("sig", F.col("a").alias("node"))).unionByName(whole.select("sig", F.col("b").alias("node")))
    release_shuffles(docs.sparkSession)
    nodes = materialize(_parted(links.of(open_.distinct()), "sig").select("node").distinct(), "open-nodes")
    if not nodes.isEmpty():
        links.grams = links.sets(nodes, "open-grams")
        release_shuffles(docs.sparkSession)
        _refine(nodes, links, percent, few, rounds)
    discard(members, stars, missed)
    by_set = first.join(links.labels.withColumnRenamed("node", "first"), "first", "left").select("digest", F.coalesce("component", "first").alias("component_id"))
    return sets.join(by_set, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))

"""Greedy selection against the sequential loop."""

from __future__ import annotations

import random

import pytest

from promptlake.operators import clusters as cl
from promptlake.operators.language import set_pairs
from promptlake.storage import written


def greedy(nodes, links):
    """The loop: who is kept, and the first kept one of the others."""
    near, leader = {frozenset(x) for x in links}, {}
    for i in sorted(nodes):
        leader[i] = next((j for j in sorted(leader) if leader[j] == j and frozenset((i, j)) in near), i)
    return leader


def led(spark, links):
    found, rounds = cl.leaders(spark.createDataFrame([(*x, 0.9) for x in links], "a long, b long, jaccard double"))
    return {r.node: r.leader for r in found.collect()}, rounds


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    links = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range([20, 60, 150, 400][seed])})
    found, rounds = led(spark, links)
    want = greedy(range(n), links)
    assert {i: found.get(i, i) for i in range(n)} == want and rounds <= n


def test_rounds_are_the_longest_wait(spark):
    """Along a chain every second text stays, each round decides two; around a hub one round decides all."""
    found, rounds = led(spark, [(i, i + 1) for i in range(8)])
    assert found == {1: 0, 3: 2, 5: 4, 7: 6} and rounds == 4
    found, rounds = led(spark, [(0, i) for i in range(1, 300)])
    assert found == dict.fromkeys(range(1, 300), 0) and rounds == 1
    assert led(spark, []) == ({}, 0)


def jaccard(a, b):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {" ".join(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def texts():
    rng, found = random.Random(4), []
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(40)]
        for _ in range(6):
            w = list(words)
            for k in rng.sample(range(40), rng.randint(0, 3)):
                w[k] = f"x{rng.randint(0, 3)}"
            found.append(" ".join(w))
    return [*found, None, "", "One", "one", found[0], found[7]]


@pytest.mark.parametrize("percent", [75, 85])
def test_texts_in_order(spark, percent):
    rows = list(enumerate(texts()))
    links = [(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= percent / 100 - 1e-12]
    found = {r.node: (r.leader, r.likeness) for r in cl.grouped(spark.createDataFrame(rows, "node long, text string"), percent).collect()}
    want = greedy(range(len(rows)), links)
    assert {i: x for i, (x, _) in found.items()} == want
    assert all(abs(s - (1 if i == x else jaccard(rows[i][1], rows[x][1]))) < 1e-6 for i, (x, s) in found.items())


def test_blocks_within_a_text(spark):
    """Order stays right where protected blocks stand between; the same line in two texts is compared in neither's stead."""
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "\n".join([long, "b", "PROTECTED_1 " + long, long + " more", "c", "d", "b"])), (2, "\n".join([long, "b", "c", "e"])), (3, None), (4, ""), (5, "\n".join([long, "b", "c", "e", "f"])), (6, "\n" * 6)]
    found = {r.doc_id: (r.text, r.removed) for r in cl.deduplicated_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = "\n".join([long, "b", "PROTECTED_1 " + long, "c", "d"])
    assert found == {1: (kept, 2), 2: (rows[1][1], 0), 3: (None, 0), 4: ("", 0), 5: (rows[4][1], 0), 6: ("", 6)}


def test_report_keeps_tenants_apart(spark):
    rows = [("a", i, x) for i, x in enumerate(texts())] + [(None, 100 + i, x) for i, x in enumerate(texts()[:3])]
    found = {r.tenant: r for r in cl.similarity_report(spark.createDataFrame(rows, "tenant string, node long, text string")).collect()}
    own = [x for x in rows if x[0] == "a"]
    links = [(i, j) for _, i, a in own for _, j, b in own if i < j and jaccard(a, b) >= 0.75 - 1e-12]
    want = greedy([x[1] for x in own], links)
    sizes = [n for n in map([*want.values()].count, {*want.values()}) if n > 1]
    assert (found["a"].clusters, found["a"].clustered) == (len(sizes), sum(sizes)) and None in found


def moved(spark):
    """Bytes that stages have written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList
    stages = spark._jsc.sc().statusStore().stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_set_pairs(spark):
    """Pairs of near sets, with a member that all hold and with equal sets; what is moved stays below the size of the sets where few are near."""
    rng = random.Random(5)
    sets = [[7] + [rng.getrandbits(62) for _ in range(100)] for _ in range(2000)]
    sets += [[*x[: 101 - i % 30], *(rng.getrandbits(62) for _ in range(i % 9))] for i, x in enumerate(sets[:60])] + sets[:3] + [[7], [7], [7, 9]]
    rows = [(i, sorted(x)) for i, x in enumerate(sets)]
    table = written(spark.createDataFrame(rows, "node long, s array<long>"), "sets")
    before = moved(spark)
    pairs = set_pairs(table, 85).collect()
    assert moved(spark) - before < 8 * sum(map(len, sets))
    found = {(r.a, r.b): (r.n, r.union, r.jaccard) for r in pairs}
    first = {}
    for i, x in rows:
        first.setdefault(tuple(x), i)
    # only what shares more than the common member can be near
    want = {}
    for a, b in [(i, 2000 + i) for i in range(60)]:
        x, y = {*sets[a]}, {*sets[b]}
        if x != y and first[tuple(sorted(y))] == b and 100 * len(x & y) >= 85 * len(x | y):
            want[a, b] = (len(x & y), len(x | y), round(len(x & y) / len(x | y), 6))
    assert found == want and want


def test_sets_far_apart_do_not_meet(spark, monkeypatch):
    """Texts that share a rare passage and little else are ruled out by parities: only sets of near pairs are exchanged."""
    from promptlake.operators import language as la
    from pyspark.sql import functions as F

    rng = random.Random(8)
    passage = [f"rare{k}" for k in range(12)]
    rows = [" ".join([f"t{i}w{k}" for k in range(60)] + passage) for i in range(20)]
    near = [f"n{k}" for k in range(90)]
    rows += [" ".join(near), " ".join([*near[:-1], "other"]), " ".join(near)]
    sets = written(spark.createDataFrame(list(enumerate(rows)), "node long, text string").select("node", la.tx.hashed_shingles(F.col("text"), 3).alias("s")), "sets")
    kept = []
    monkeypatch.setattr(la, "written", lambda df, name: kept.append((name, out := written(df, name))) or out)
    for percent in (75, 85):
        kept.clear()
        found = la.set_pairs(sets, percent).select("a", "b").collect()
        assert [tuple(r) for r in found] == [(20, 21)]
        assert {r[0] for r in dict(kept)["near-nodes"].collect()} == {20, 21} and [r[0] for r in dict(kept)["equal-sets"].collect()] == [22]
    x, y = ({rng.getrandbits(63) for _ in range(n)} for n in (40, 200))
    for a, b in ((x, y), (x, x | y), (y, set(sorted(y)[:-5])), (y, y)):
        bits = [bytes(r.bits) for r in la.parities(spark.createDataFrame([(k, sorted(s)) for k, s in enumerate((a, b))], "node long, s array<long>")).orderBy("node").collect()]
        assert la._odd_bits(*bits) <= len(a ^ b) and (la._odd_bits(*bits) > 0) == (a != b)

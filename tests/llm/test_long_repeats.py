"""Removal of long repeats against a set of all windows seen, its run-length index against plain search, and edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from promptlake.llm import long_repeats as lr
from promptlake.llm.common import documents

SCHEMA = "doc_id long, text string, a long, s string, p int, kind int, bytes string"
SMALL = {"few": 2, "most": 3, "part": 300, "bytes_a_task": 5000, "strings_a_task": 50}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in rows], SCHEMA)


def brute(rows, window=100):
    """In the order of the contract; rows equal in both fields are one document."""
    seen, found = {}, []
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - window + 1):
            first = seen.setdefault(data[k : k + window], (i, text, k))
            if first != (i, text, k):
                covered[k : k + window] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        found.append((i, len(data), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~covered].tobytes()).hexdigest()))
    return sorted(found, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Copies, near copies, a passage in many texts, periodic texts, nulls, empty texts, repeats, other scripts, texts about the window's length."""
    rng = random.Random(5)
    passage, base = prose(rng, 40), prose(rng, 80)
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101), (6, "ab" * 400), (7, "ab" * 400), (8, "漢字仮名" * 60), (9, "é" + "漢字仮名" * 60), (10, "😀" * 30), (None, passage), (11, base), (11, base)]
    rows += [(100 + k, prose(rng, rng.randint(0, 30)) + (" " + passage if k % 3 else "") + " " + prose(rng, rng.randint(0, 30))) for k in range(60)]
    for k in range(30):
        words = base.split()
        words[rng.randrange(80)] = f"e{k}"
        rows.append((200 + k, " ".join(words)))
    return [*rows, (300, prose(rng, 3000)), (301, passage[:99]), (302, passage[5:105] + "\n" + passage[5:105]), (303, base)]


@pytest.mark.parametrize("limits", [{}, SMALL, SMALL | {"few": 1, "most": 1}, SMALL | {"few": 1000, "most": 1000}])
def test_equals_all_windows(spark, limits):
    """Whether stretches are compared as bytes through the index or, of frequent anchors, as windows."""
    rows = corpus()
    assert found(lr.without_repeats(frame(spark, rows), **limits)) == brute(rows)


def test_query_equals_all_windows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert found(lr.op11_long_repeats(spark, sf_dir)) == brute(rows)


def test_other_window(spark):
    rows = corpus()
    assert found(lr.without_repeats(frame(spark, rows), window=40, anchor=9)) == brute(rows, 40)


def test_removed_runs(spark):
    rows = [(1, "a" * 50 + "b" * 100), (2, "c" * 7 + "a" * 50 + "b" * 60 + "d" * 9)]
    assert lr.without_repeats(frame(spark, rows)).filter("doc_id = 2").first().removed == [(7, 117)]


def test_empty_table(spark):
    assert lr.without_repeats(frame(spark, [])).collect() == []


def test_one_group_of_many_different_stretches(spark):
    """2,000 texts hold one passage, each with neighbours of its own, and 300 are equal."""
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [(k, f"{prose(rng, 5)} {passage} {prose(rng, 5)}") for k in range(2000)] + [(5000 + k, passage) for k in range(300)]
    assert found(lr.without_repeats(frame(spark, rows))) == brute(rows)


# --- the index


def text_of(strings):
    return np.concatenate([x for s in strings for x in (np.frombuffer(s, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64))])


def test_matching_statistics_equal_plain_search():
    rng = random.Random(1)
    for trial in range(100):
        letters = b"ab" if trial % 2 else b"abcd"
        strings, queries = ([bytes(rng.choice(x) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))] for x in (letters, b"abcd"))
        got = lr.RunIndex(text_of(strings)).statistics(text_of(queries)[text_of(queries) > 0], np.cumsum([*map(len, queries)]), 12)
        want = [max(n for n in range(13) if n <= len(q) - i and any(q[i : i + n] in s for s in strings)) for q in queries for i in range(len(q))]
        assert got.tolist() == want


def test_runs_of_the_transform():
    """Runs are those of the transform of plainly sorted suffixes; their number hardly grows with copies."""
    strings = [b"banana", b"bandana", b"banana"]
    text = text_of(strings)
    order = sorted(range(len(text)), key=lambda i: [(0, k) if text[k] == 0 else (1, text[k]) for k in range(i, len(text))])
    assert lr.suffix_order(text).tolist() == order
    index = lr.RunIndex(text)
    before = text[np.array(order) - 1]
    assert np.repeat(index.symbols, index.lasts - index.starts + 1).tolist() == before.tolist()
    assert [order[i] - 1 for i in index.starts] == index.first_place.tolist() and [order[i] - 1 for i in index.lasts] == index.last_place.tolist()
    base = prose(random.Random(2), 200).encode()
    one, many = (len(lr.RunIndex(text_of([base] * n)).starts) for n in (1, 20))
    assert many < 1.5 * one


def test_rolling_hashes_and_least():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(300)), np.uint8)
    for size, h in zip((1, 3, 24, 100), lr.rolling(data, (1, 3, 24, 100))):
        known = {}
        assert len(h) == 301 - size and all(known.setdefault(data[i : i + size].tobytes(), x) == x for i, x in enumerate(h.tolist()))
        assert len({*h.tolist()}) == len(known)
    keys = np.array([rng.randrange(50) for _ in range(100)], np.uint64)
    for width in (1, 2, 3, 7, 77):
        assert lr.least_of(keys, width).tolist() == [min(keys[i : i + width]) for i in range(101 - width)]


def test_windows_are_exchanged_once(spark):
    """A window equal to an earlier one is a span, by text order; its rows go through one exchange, and not with columns that all share."""
    rng = random.Random(6)
    rows = [(lr.WINDOWS, rng.randrange(3), rng.randrange(4), rng.randrange(5), rng.randrange(2), rng.randrange(50), 1) for _ in range(200)] + [(lr.WINDOWS, 9, 9, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, lr.ROWS)
    firsts = {}
    for r in rows:
        firsts[r[1:3]] = min(firsts.get(r[1:3], r[3:6]), r[3:6])
    later = lr.later_windows(df)
    assert sorted(tuple(r) for r in later.collect()) == sorted((*r[3:6], 1) for r in rows if r[3:6] > firsts[r[1:3]])
    plan = lr.later_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan

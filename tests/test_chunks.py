"""Chunks against a plain recursive splitter, intents and choice against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest

from promptlake.operators import chunks as ch


def split(text, separators, size):
    parts = text.split(separators[0]) if separators[0] != " " else [w + " " for w in text.split()]
    if separators[0] == " " and parts:
        parts[-1] = parts[-1][:-1]
    return [x for p in parts for x in (split(p, separators[1:], size) if len(p) > size and separators[1:] else [p])]


def plain(text, size):
    parts = split(text, ch.SEPARATORS, size) if text else []
    found, now = [], ""
    for part in filter(str.strip, parts):
        if len(now) + len(part) <= size:
            now = f"{now} {part}".strip()
        else:
            found += [now] if now else []
            now = part
    return [*found, now] if now else found or parts


def texts():
    rng = random.Random(6)
    ends = ["\n\n", "\n", ". ", "? ", "! ", " ", "  ", "\t"]
    return ["", " ", "\n\n", "x" * 100, "a b", *("".join("w" * rng.randint(1, 12) + rng.choice(ends) for _ in range(rng.randint(1, 80))) for _ in range(60))]


@pytest.mark.parametrize("size", [5, 20, 64])
def test_chunks(spark, size):
    rows = [*enumerate(texts()), (999, None)]
    df = spark.createDataFrame(rows, "i long, t string")
    found = {r.i: r.c for r in df.select("i", ch.chunks(df["t"], size).alias("c")).collect()}
    assert found == {i: None if t is None else plain(t, size) for i, t in rows}
    for i, t in rows[:-1]:  # nothing but separators and blanks is lost, in order
        strip = lambda x: "".join(c for c in x if c not in " \n\t.?!")
        assert strip("".join(found[i])) == strip(t)


def test_intent(spark):
    rows = ["a\n\n b \nWHAT now\nhow", "one\ntwo\nthree\nfour\nfive\nwhat", "", " \n", "somewhat\nx", "z" * 400 + " how"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r[0] for r in df.select(ch.intent(df["t"])).collect()] == ["WHAT now", "one", "", "", "somewhat", "z" * 300]


def cosine(a, b):
    x, y = (Counter(hashlib.sha256(w.encode()).hexdigest()[:3] for w in t.lower().split()) for t in (a, b))
    norm = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    return round(sum(n * y[w] for w, n in x.items()) / norm, 6) if norm else 0.0


@pytest.mark.parametrize("least", [0.0, 0.3, 0.99])
def test_semantic_stage(spark, least):
    rows = [(1, "explain the cat\n\nthe cat sat on the mat\n\nnothing of that here\n\nexplain the cat"), (2, "one chunk"), (3, ""), (4, "how\n\n" + "b c d e f g h i\n\n" * 4)]
    found = {r.doc_id: r for r in ch.semantic_stage(spark.createDataFrame(rows, "doc_id long, t string"), least, 20).collect()}
    for i, t in rows:
        cut = plain(t, 20)
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        asked = lines[0] if lines else ""
        scores = [cosine(c, asked) for c in cut]
        kept = [k for k, s in enumerate(scores) if s >= least] or ([scores.index(max(scores))] if scores else [])
        r = found[i]
        if len(cut) < 2:
            assert (r.text, r.chunks, r.kept, r.dropped_ratio) == (t, len(cut), len(cut), 0)
        else:
            assert (r.text, r.chunks, r.kept) == (" ".join(cut[k] for k in kept), len(cut), len(kept))
            assert abs(r.score_kept - sum(scores[k] for k in kept) / len(kept)) < 1e-5

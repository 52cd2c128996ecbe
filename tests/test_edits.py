"""Example blocks against a plain loop over lines; hunks against the texts that they join."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from promptlake.operators import diffs as df
from promptlake.operators import examples as ex

TEXT = """Do this, for example use a map
use a list
use a list
# stop
not an example
Such as  
one two three four five six seven
one two three four five six seven eight
PROTECTED_1 one two three four five six seven eight

gone. For instance a b for example c d
x y z"""


def plain(text):
    found, inside = [], False
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if re.search(rf"\b({ex.MARKERS})\b", line, re.I):
            inside = True
            parts = re.split(rf"\b({ex.MARKERS})\s*", line, flags=re.I)
            found += [(i, parts[2].strip())] if len(parts) > 2 and parts[2].strip() else []
        elif inside and line and not line.startswith("#"):
            found.append((i, line))
        else:
            inside = False
    return found


def likeness(a, b):
    x, y = ({" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or {" ".join(w)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def plain_reduced(text, most):
    found = plain(text)
    leaders = []
    for i, line in found:
        if not any(likeness(line, other) >= 0.7 for _, other in leaders):
            leaders.append((i, line))
    kept = {i for i, _ in (found if len(found) <= most else leaders[:most])}
    gone = {i for i, _ in found} - kept
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone or "PROTECTED_" in x)


def texts():
    rng = random.Random(2)
    lines = ["for example a b c d", "For instance", "such as", "# h", "", "a b c d", "a b c e", "q r s t u v w", "q r s t u v w x", "PROTECTED_2 z", "e.g.x y", "example:k"]
    return [TEXT, "", None, "none", *("\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(25))]


@pytest.mark.parametrize("most", [1, 3])
def test_examples(spark, most):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, t string")
    found = sorted(tuple(r) for r in ex.examples(docs).collect())
    assert found == [(d, i, x) for d, t in rows for i, x in plain(t)]
    got = {r.doc_id: (r.text, r.removed) for r in ex.reduced(docs, most).collect()}
    for d, t in rows:
        if t is None:
            assert got[d][0] is None
        else:
            want = plain_reduced(t, most)
            assert got[d] == (want, len(t.split("\n")) - len(want.split("\n")) if want or not t else len(t.split("\n")))


def test_hunks(spark):
    rng = random.Random(9)
    pairs = [("", ""), ("a", "a"), ("a\nb\nc", "a\nx\nc"), (None, "a"), ("a\n", None), ("a\nb", "b\na"), ("\n\n", "\n")]
    for _ in range(60):
        a = [rng.choice("abcdefgh") + rng.choice(["", "1", "2"]) for _ in range(rng.randint(0, 15))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("abxyz"))
        pairs.append(("\n".join(a), "\n".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("h", df.line_hunks("a", "b"))
    for r in rows.withColumn("back", df.applied(F.col("a"), F.col("h"))).collect():
        assert r.back == (r.b or "")
        lines, other = (r.a or "").split("\n"), (r.b or "").split("\n")
        assert (r.h == []) == (lines == other)
        for h in r.h:
            old, new = lines[h.a_from : h.a_to], other[h.b_from : h.b_to]
            assert new == list(h.lines) and (old or new) and old[:1] != new[:1] and old[-1:] != new[-1:]


def test_lines_that_stay_are_no_part_of_hunks():
    a = [f"l{k}" for k in range(50)]
    b = ["new", *a[:10], *a[11:30], "x", "y", *a[30:]]
    assert [(h["a_from"], h["a_to"], h["lines"]) for h in df.hunks(a, b)] == [(0, 0, ["new"]), (10, 11, []), (30, 30, ["x", "y"])]


def test_changes(spark):
    rows = [("you must not go home", "you go home"), ("a b c d", "a"), ("a b c d", "a b c"), ("", "a"), (None, None)]
    got = [(r.risk, r.lost_words, r.token_delta) for r in spark.createDataFrame(rows, "a string, b string").select(*df.compared(F.col("a"), F.col("b"))).collect()]
    assert [x[:2] for x in got] == [("high", "must,not"), ("high", ""), ("medium", ""), ("low", ""), ("high", "")] and got[0][2] < 0 < got[3][2]

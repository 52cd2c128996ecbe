"""Protected spans at length: one pass gives what replacing number by number gives, and kinds are passed over only where they cannot be."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from promptlake.functions import rules, spans
from promptlake.operators import chunks as ch
from promptlake.operators import language as la
from promptlake.operators import measures as me
from promptlake.operators import text as tx

MARK = "PROTECTED_"


def one_by_one(text: str, originals: list[str]) -> str:
    for i in range(len(originals), 0, -1):
        text = text.replace(f"{MARK}{i}", originals[i - 1])
    return text


def test_spans_put_back_in_one_pass_as_one_by_one():
    chance = random.Random(3)
    for _ in range(3000):
        piece = lambda n: "".join(chance.choice(["a", " ", "7", "0", f"{MARK}{chance.randint(0, n + 2)}", f"{MARK}{chance.randint(1, 30)}.", MARK]) for _ in range(chance.randint(0, 6)))
        originals = [piece(i) or "x" for i in range(chance.randint(0, 25))]
        # a span holds earlier ones only
        originals = [re.sub(rf"{MARK}(\d+)", lambda m, i=i: m[0] if int(m[1]) <= i else "y", x) for i, x in enumerate(originals)]
        text = piece(len(originals))
        whole = la._whole(originals, MARK)
        assert whole == [one_by_one(x, originals[:i]) for i, x in enumerate(originals)]
        assert la._put_back(text, whole, originals, MARK) == one_by_one(text, originals)


def test_many_spans_within_seconds(spark):
    text = " ".join(f"see a{i}@example.com or https://example.com/{i} by 2025-12-31," for i in range(1500))
    p = spark.createDataFrame([(text,)], "t string").withColumn("p", la.protect(F.col("t")))
    start = time.time()
    row = p.withColumn("back", la.reinject(F.col("p.text"), F.col("p.originals"), F.col("p.mark"))).select("t", "back", F.size("p.originals").alias("n"), la.missing(F.col("back"), F.col("p.originals"), F.col("p.mark")).alias("lost")).first()
    assert row.back == row.t and row.lost == [] and row.n >= 4500
    assert time.time() - start < 20  # one replacement and one list of spans a span took minutes


def test_kinds_passed_over_hold_no_span():
    texts = ["a.b 1,2", "At 10:30 - 11:45 PM, 50 %", "٣٤ kg, Article ٣", "fe80::1 ::", "x = y $a$ \\(b\\)", "C:\\a\\b /usr/lib", "12 USD €5 1.2.3 v1.2.3-a 1.1.1.1", "48° 51' 24\" N 1.5, 2.5", "{{a}} %s <b/>", "`x` ~~~\na\n~~~", "---\na: 1\n---"]
    for kind, pattern, flags in spans.PROTECTED:
        for x in texts:
            if not la._may_hold(x, kind):
                assert not re.search(pattern, x, flags), (kind, x)


def test_stretches_as_whole_texts(spark):
    parts = ["In order to", "a lot\nof", "very", "quite", "please  ", "Thank you in advance for your help", "due to the fact that", "e.g.", "ſuch as", "I'm looking for ", "could you", "Tell me", "!", ".", ",", "; ", "  ", "\u0301", "é", "word", "veryx", "as well as", "you must "]
    chance = random.Random(5)
    texts = [("".join(chance.choice(parts) + chance.choice(["", " "]) for _ in range(12)),) for _ in range(400)]
    steps = tx._steps(rules.PHRASES_EN) + tx._steps(rules.FLUFF_EN) + tx._COURTESY
    rows = spark.createDataFrame(texts, "t string").select("t", tx.in_stretches(F.col("t"), steps).alias("a"), tx.chain(F.col("t"), steps).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and any(r.a != r.t for r in rows)


def test_plain_prose_is_rewritten_fast(spark):
    t = spark.range(1).select(F.repeat(F.lit("Shanre anin the ndenon of thenat, ertion and. "), 40_000).alias("t"))
    steps = tx._steps(rules.PHRASES_EN) + tx._steps(rules.FLUFF_EN) + tx._COURTESY

    def seconds(x) -> float:
        start = time.time()
        assert t.select(F.length(x)).first()[0] > 0
        return time.time() - start

    seconds(tx.in_stretches(F.col("t"), steps))
    assert 2 * seconds(tx.in_stretches(F.col("t"), steps)) < seconds(tx.chain(F.col("t"), steps))


def test_likeness_of_long_texts_within_seconds(spark):
    t = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("w"), (i * i % 7919).cast("string"))), " ").alias("t"))
    start = time.time()
    same = t.select(me.let(F.struct(ch.hashed(F.col("t")).alias("a"), ch.hashed(F.left("t", F.lit(50_000))).alias("b")), lambda x: F.struct(ch.likeness(x["a"], x["a"]).alias("one"), ch.likeness(x["a"], x["b"]).alias("less")))).first()[0]
    assert abs(same.one - 1) < 1e-12 and 0 < same.less < 1
    assert time.time() - start < 30  # pairs of words: 1.6 thousand million


def test_kinds_that_a_text_cannot_hold_are_not_searched_for():
    """What spans of these kinds need, by texts with and without them; each text's kinds found are among those that it may hold."""
    import re

    from promptlake.functions import spans

    without = {"hash": "a hex word of few letters", "chemical": "Words and No numbers", "ipv6": "at 12:30 or a:b", "math": "no sign", "quoted": "no mark"}
    held = {"hash": "x " + "ab12" * 8, "chemical": "NaCl", "ipv6": "1:2:3:4:5:6:7:8", "math": "x = 3", "quoted": "«x»"}
    found = {kind: re.compile(pattern, flags) for kind, pattern, flags in spans.PROTECTED}
    for kind in held:
        assert found[kind].search(held[kind]) and la._may_hold(held[kind], kind)
        assert not la._may_hold(without[kind], kind) and not found[kind].search(without[kind])
    for text in ("::1", "H2O", "HCl", "NaOH", "\\(a\\)", "$a$", "'a'", '"a"', "「a」", "a ⊕ b"):
        assert all(la._may_hold(text, kind) for kind in found if found[kind].search(text))

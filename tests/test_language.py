"""Operators of detection, protection and compression against plain Python and worked examples."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptlake.functions import lexicon, spans
from promptlake.operators import compiler as co
from promptlake.operators import language as la
from promptlake.operators import measures as me
from promptlake.operators import text as tx


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, t string")


def results(spark, column, texts):
    return [r.x for r in table(spark, texts).select("i", column.alias("x")).orderBy("i").collect()]


TEXTS = [
    "Write a function in Python to test the api and debug it.", "Translate this in French, please.", "What is the definition of a test?", "résume les points clés", "", "   ",
    "How to install docker: steps, step by step guide for Kubernetes and the database cache.", "Summarize the key points. Compare the data and the trend.", "def  class", "The patient's diagnosis by Doctor Jane Smith of Boston General.", "Plain words here.",
]


def test_task_and_specificity(spark):
    hit = lambda w, t: re.search(rf"(?<!\w){re.escape(w)}(?!\w)", t, re.I) is not None
    tasks, kinds = [], []
    for text in TEXTS:
        scores = {k: sum(hit(w, text) for w in v) for k, v in lexicon.TASKS.items()}
        best = max(scores, key=scores.get)
        tasks.append(best if scores[best] else "factuel")
        n = sum(hit(w, text) for w in dict.fromkeys(x for p in lexicon.TERMS for x in p))
        names = len(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text))
        kinds.append("entity_rich" if n >= 3 or n >= 1 and names >= 3 else "domain_jargon" if n >= 1 or names >= 2 else "generic")
    assert results(spark, la.task(F.col("t")), TEXTS) == tasks
    assert results(spark, la.specificity(F.col("t")), TEXTS) == kinds


MIXED = [
    'Mail a.b@example.com on 2025-01-31 at 10:30 AM, see https://x.org/a?b=1, or "quoted text" and `code`.', "No spans here", None, "", "```py\nx = 1\n``` and {{name}} of {user}: 55 %.",
    "".join(f"`v{k}` " for k in range(12)), "<b>bold \"x\"</b> v1.2.3 at 10.0.0.1 by @me",
    "12 March 2024, March 3, 2024; 10:30-11:45; www.x.org/a; 5 kg for $ 20.50 USD or 30 EUR under Article 12.3", "call +33 612 345 678, {\"a\": {\"b\": 1}}, /usr/lib/x.so, &amp; #ff00ff fe80::1 H2O x = 5 48.85, 2.35",
    "PROTECTED_3 and protected_1 `a` PROTECTEDQ_2 `b`", "\"outer `inner` 12:30\" 'single' 「q」", "550e8400-e29b-41d4-a716-446655440000 d41d8cd98f00b204e9800998ecf8427e :8080, %s <br/>",
]


def protected(text):
    """The kinds one after the other, as a loop over patterns."""
    found, mark = [], "PROTECTED_"
    while mark in (text or "").upper():
        mark = mark.replace("_", "Q_")
    for kind, pattern, flags in spans.PROTECTED:
        def taken(m, kind=kind):
            found.append((kind, m[0]))
            return f"{mark}{len(found)}"

        text = text and re.sub(pattern, taken, text, flags=flags)
    return text, found, mark


def test_protection_round_trip(spark):
    back = la.reinject(F.col("p.text"), F.col("p.originals"), F.col("p.mark"))
    df = table(spark, MIXED).withColumn("p", la.protect(F.col("t"))).withColumn("back", back)
    lost = lambda x: la.missing(x, F.col("p.originals"), F.col("p.mark"))
    rows = df.select("i", "t", "p", "back", F.size(lost(F.col("back"))).alias("lost"), lost(F.lit("nothing")).alias("all")).orderBy("i").collect()
    for r in rows:
        assert r.back == r.t and (r.p.text, [(o.kind, o.original) for o in r.p.originals], r.p.mark) == protected(r.t)
        assert not r.t or r.lost == 0 and r.all == list(range(1, len(r.p.originals) + 1))
    assert "example.com" not in rows[0].p.text and "2025" not in rows[0].p.text and "code" not in rows[0].p.text
    assert len(rows[5].p.originals) == 12
    kinds = {o.kind for r in rows for o in r.p.originals}
    assert {"date", "unit", "currency", "legal_ref", "time_range", "semi_url", "phone", "json", "path", "html_entity", "hex_color", "ipv6", "chemical", "math", "coords"} <= kinds


def test_protected_blocks_are_merged(spark):
    texts = ["a $$x$$ b", "```py\nx\n```\nrest", "<a>x</a><b>y</b>", "none", "", "{\n  \"k\": 1\n}", "| a | b |\n|---|---|\n| 1 | 2 |\n"]
    got = results(spark, la.protected_blocks(F.col("t")), texts)
    assert [[(b.label, b.start, b.end) for b in x] for x in got] == [
        [("latex_display", 2, 7)], [("fenced_code", 0, 11)], [("xml_block", 0, 16)], [], [], [("json_block", 0, 12)], [("markdown_table", 0, 30)],
    ]
    assert results(spark, F.round(la.protected_ratio(F.col("t")), 4), ["a $$x$$ b", "", "none"]) == [round(5 / 9, 4), 0.0, 0.0]


def test_compiled_keeps_spans_and_negations(spark):
    texts = ["Please note that, in order to win, you must not pay 55 % however late; see https://x.org/in-order-to-pay.", "Basically, very good"]
    rows = co.compiled(table(spark, texts).withColumnRenamed("i", "doc_id"), "balanced").orderBy("doc_id").collect()
    assert "https://x.org/in-order-to-pay" in rows[0].compressed and "55 %" in rows[0].compressed and " not " in rows[0].compressed and "¬" not in rows[0].compressed
    assert rows[0].lost == 0 and rows[0].spans >= 1 and not rows[0].fall_back and len(rows[0].compressed) < len(texts[0]) and "in order to win" not in rows[0].compressed


def test_sentence_folds(spark):
    s = [["One thing.", "Another. ", "Actually no, keep it."], ["Scratch that"], ["A b c", "A b c d", "x y z", "x y z"], ["First.", "Use this, never mind."], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(s)], "i long, s array<string>")
    rows = df.select("i", la.without_cancelled(F.col("s")).alias("a"), la.without_repeats(F.col("s")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [["One thing."], [], ["A b c", "A b c d", "x y z", "x y z"], ["Use this,"], []]
    assert [r.b for r in rows] == [s[0], s[1], ["A b c", "x y z"], s[3], []]


def test_negation(spark):
    assert results(spark, la.mark_negated(F.col("t")), ["I do not, I don't"]) == ["I do ¬not¬, I ¬don't¬"]
    assert results(spark, la.unmark_negated(la.mark_negated(F.col("t"))), ["never can't"]) == ["never can't"]
    assert results(spark, la.consolidate_negations(F.col("t")), ["It is Not Impossible, PROTECTED_12 said"]) == ["it is possible, PROTECTED_12 said"]
    assert results(spark, la.negated_segments(F.col("t")), ["I go. He does not. Never! Yes."]) == [["He does not.", "Never!"]]
    assert results(spark, la.has_affixal_negation(F.col("t")), ["a hopeless case", "a good day"]) == [True, False]
    assert results(spark, la.stance(F.col("t")), ["It is always so, perhaps", "maybe about ten", "kind of", "x"]) == ["certain", "speculative", "hedged", ""]


def test_detection(spark):
    assert results(spark, la.language(F.col("t")), ["le chat et la souris dans un sac", "the cat", "le chat", ""]) == ["fr", "en", "en", "en"]
    assert results(spark, la.format_of_name(F.col("t")), ["a/b.PY", "x", "y.htm", "z.docx"]) == ["code", "txt", "html", "txt"]
    long = "x" * 60
    kinds = results(spark, la.text_type(F.col("t"), F.lit("txt"), F.lit("en")), ["short", long + " import os", long + " Speaker 1: hi", long + " Section four", long, None])
    assert kinds == ["short", "code", "meeting", "legal", "general", "short"]
    assert results(spark, la.max_profile(F.col("i") / 4.0), ["", "", "", "", ""]) == ["bypass", "light", "balanced", "max", "max"]


def test_markdown_rows(spark):
    text = "| a | b |\n|:--|--:|\n| 1 | 2 | 3 |\n|4|5|\nnot a row\n"
    assert results(spark, la.markdown_rows(F.col("t")), [text, "no table", ""]) == [[["1", "2"], ["4", "5"]], [], []]


def rouge(a, b):
    a, b = a.lower().split(), b.lower().split()
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    n = t[-1][-1]
    return 0.0 if not n else 2 * (n / len(b)) * (n / len(a)) / (n / len(b) + n / len(a))


def bleu(a, b):
    import math

    a, b = a.lower().split(), b.lower().split()
    if not a or not b:
        return 0.0
    logs = 0.0
    for n in (1, 2, 3, 4):
        x, y = (Counter(zip(*(w[k:] for k in range(n)))) for w in (a, b))
        logs += math.log(max(sum((x & y).values()) / sum(y.values()) if x and y else 0.0, 1e-10))
    return min(1.0, math.exp(1 - len(a) / len(b))) * math.exp(logs / 4)


@pytest.mark.parametrize("measure, brute", ((me.rouge_l, rouge), (me.bleu, bleu)))
def test_overlap_measures(spark, measure, brute):
    pairs = [("the cat sat on the mat today", "the cat is on the mat"), ("a b c d e a b c d e", "a b c d e f a b c"), ("", "a"), ("a", ""), ("x y", "x y"), ("p q r", "s t u"), ("one two three four five six", "one two three four five six")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    got = [r.x for r in df.select("i", measure(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == pytest.approx([brute(a, b) for a, b in pairs], abs=1e-9)


def test_similar_pairs_against_all_pairs(spark):
    import random

    rng, texts = random.Random(5), []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(rng.choice([2, 5, 30, 60]))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{len(texts)}"
            texts.append(" ".join(w))
    sets, first = {}, {}
    for i, text in enumerate(texts):
        w = text.split()
        s = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)])
        if s not in first:
            first[s] = i
            sets[i] = s
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert want and {(r.a, r.b) for r in la.similar_pairs(table(spark, texts).toDF("doc_id", "text")).collect()} == want


def test_minhash_is_near_the_exact_likeness(spark):
    a, b = " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(30, 130))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(la.minhash(tx.shingles(F.col("a"), 1)).alias("a"), la.minhash(tx.shingles(F.col("b"), 1)).alias("b"))
    assert abs(df.select(la.minhash_likeness(F.col("a"), F.col("b")).alias("x")).first().x - 70 / 130) < 0.2


def test_preferences_keep_the_last(spark):
    rows = [("u", 1, "answer in english, short"), ("u", 2, "in French and as a table"), ("v", 1, "nothing told")]
    got = {(r.user_id, r.kind): r.value for r in la.preferences(spark.createDataFrame(rows, "user_id string, at long, text string")).collect()}
    assert got == {("u", "language"): "fr", ("u", "format"): "table"}


def test_critical_content(spark):
    texts = ["see https://x.org/abc and a@b.com now", 'with {"key": "value"} and `some code`', "nothing"]
    assert results(spark, F.sort_array(la.critical_missing(F.col("t"), F.lit("a@b.com"))), texts) == [["url"], ["code_inline", "json_obj"], []]


# --- profiles

BLOCKS = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
PROMPTS = [
    "\n\n".join(["Explain this, please.", f"{BLOCKS} one", f"{BLOCKS} one", f"{BLOCKS} lambda mu nu xi omicron pi rho sigma tau", f"{BLOCKS} lambda mu nu xi omicron pi rho sigma tau upsilon", "It is not impossible at 10:30.", "The last one stands alone."]),
    "", None, "PROTECTED_1 stays, as does `code`; you must not lose https://x.org/a.", "short",
]


@pytest.mark.parametrize("profile", [*spans.PHASES])
def test_profiles(spark, profile):
    rows = co.compiled(table(spark, PROMPTS).withColumnRenamed("i", "doc_id"), profile).orderBy("doc_id").collect()
    first = rows[0].compressed
    assert first.count("alpha") == {"safe": 3, "light": 3, "balanced": 2}.get(profile, first.count("alpha")) and "¬" not in first
    if profile not in spans.CHUNK_LIKENESS:
        assert "10:30" in first and not any(r.validation for r in rows)
    assert rows[1].compressed == "" and rows[2].compressed is None
    if profile in ("safe", "light", "balanced"):
        assert all(x in rows[3].compressed for x in ("PROTECTED_1", "`code`", "not", "https://x.org/a")) and "PROTECTEDQ" not in rows[3].compressed
    assert all(r.fall_back == bool(r.validation or r.quality) for r in rows)
    assert all("PROTECTEDQ" not in (r.compressed or "") for r in rows)


def test_validation_and_quality(spark):
    df = table(spark, ["see `a` and `b` PROTECTED_9"]).withColumn("originals", F.array(*[F.struct(F.lit("inline_code").alias("kind"), F.lit(x).alias("original")) for x in ("`a`", "`c`")]))
    assert df.select(co.validation(F.col("t"), F.col("originals"), F.lit("PROTECTED_")).alias("x")).first().x == ["spans missing: 2", "placeholders left: PROTECTED_9"]
    pairs = [("a b c d", "a b c d"), ("a b c d", "x y"), ("", "x"), ("word " * 10, "word " * 40), ("abc", "abc"), ("mail `code x` to a@b.com", "mail to"), (None, "a")]
    df = spark.createDataFrame(pairs, "o string, c string")
    got = [r.x for r in df.select(co.quality(F.col("o"), F.col("c")).alias("x")).collect()]
    assert [x.errors for x in got[:5]] == [[], ["similarity"], ["token ratio"], ["token ratio"], []] and got[4].token_ratio == 1 and got[3].similarity == 1
    assert "critical content: email,code_inline" in got[5].errors and got[6].errors == ["token ratio"]


def test_equal_blocks(spark):
    texts = ["a\n\nb  c\n\na\n\nb c\n\nd", "", "one", None]
    assert results(spark, co.without_equal_blocks(F.col("t")), texts) == ["a\n\nb  c\n\nd", "", "one", None]


def test_rouge_l_of_long_answers(spark):
    """Some thousand words, by a table of lengths here; equal words, none in common, and empty texts."""
    rng = random.Random(8)
    pairs = [(" ".join(f"w{rng.randint(0, 60)}" for _ in range(1500)), " ".join(f"w{rng.randint(0, 60)}" for _ in range(1200))), ("a b a", "a b a"), ("a", "b"), ("", "b"), (None, "b"), ("b", None)]

    def length(x, y):
        row = [0] * (len(y) + 1)
        for w in x:
            before = row
            row = [0]
            for j, v in enumerate(y):
                row.append(before[j] + 1 if v == w else max(before[j + 1], row[-1]))
        return row[-1]

    df = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i long, a string, b string")
    start = time.time()
    found = {r.i: r.f for r in df.select("i", me.rouge_l(F.col("a"), F.col("b")).alias("f")).collect()}
    assert time.time() - start < 30
    for i, (a, b) in enumerate(pairs):
        x, y = (a or "").split(), (b or "").split()
        n = length(x, y)
        assert found[i] == pytest.approx(0 if n == 0 else 2 * n / (len(x) + len(y)))


def test_critical_content_of_long_words(spark):
    """A word of many letters without an address takes no search from each of its letters; what is critical is found beside it."""
    long = "a" * 100_000
    texts = [f"{long}{i}" for i in range(20)] + ["see https://a.b/c and x.y@z.org", '{"a": "b"} ["c"] `d = 1 + 2` ```\nlong code\n```', "short `x` [\"\"]", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, t string")
    start = time.time()
    found = {r.i: r.x for r in df.select("i", la.critical_missing(F.col("t"), F.lit("")).alias("x")).collect()}
    assert time.time() - start < 30
    assert [found[i] for i in range(20)] == [[]] * 20 and found[20] == ["url", "email"] and found[23] is None
    assert found[21] == ["json_obj", "code_inline", "code_inline", "code_block"] and found[22] == []

"""Sentences without request talk, repeats and what is taken back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from promptlake.functions import lexicon, rules
from promptlake.operators import language as la


def test_request_talk_as_one_phrase_after_the_other(spark):
    """Thanks run over commas to the sentence's end, and what one phrase leaves may be the next one's."""
    texts = ["Thanks, and thank you. Next one stays, please.", "Please, could you please go? I hope you are doing well; here is my request.", "I  would like\nyou to go", "\u017fthanks KINDLY \u212aindly", "", None]
    plain = F.col("t")
    for phrase in lexicon.ABOUT_THE_REQUEST:
        plain = F.regexp_replace(plain, rules.pattern(re.escape(phrase).replace(r"\ ", " ")), "")
    for phrase in lexicon.THANKS:
        plain = F.regexp_replace(plain, rf"(?iU)\b{rules.spaced(phrase)}[^.!?]*[.!?]?", "")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(plain.alias("a"), la.without_request_talk(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_words_are_taken_once_a_sentence(spark):
    s = [["a b c d e", "a b c d f", "a b c d E", "!", "!", "a b", "B a"]]
    found = spark.createDataFrame([(x,) for x in s], "s array<string>").select(la.without_repeats(F.col("s")).alias("k"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    assert found.first().k == ["a b c d e", "!", "!", "a b"]

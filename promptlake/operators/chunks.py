"""Chunks of a text: a hierarchy of separators level by level, greedy merging, and choice by likeness with what the text asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measures import let, run_counts, words

# Separators from the coarsest on, words that tell what a prompt asks for, and how much of its line counts.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ")
INTENT_WORDS = ("what", "how", "why", "which", "who", "summarize", "explain", "analyze", "generate", "create", "write", "translate", "classify", "extract")
INTENT_LINES, INTENT_LENGTH = 5, 300


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pieces(text: Column, size: int) -> Column:
    """The text cut at the first separator, and each piece of over ``size`` characters at the next, and so on. Words keep a blank behind them, but for
    the last of a piece; other separators go."""
    def cut(part: Column, separator: str) -> Column:
        if separator != " ":
            return F.split(part, separator.replace(".", r"\.").replace("?", r"\?"), -1)
        found = F.filter(F.split(part, r"(?U)\s+"), lambda w: w != "")
        return let(found, lambda w: F.transform(w, lambda x, i: F.when(i < F.size(w) - 1, F.concat(x, F.lit(" "))).otherwise(x)))

    def level(found: Column, separator: str) -> Column:
        return F.flatten(F.transform(found, lambda p: F.when(F.length(p) > size, cut(p, separator)).otherwise(F.array(p))))

    found = F.when(text == "", F.array().cast("array<string>")).otherwise(cut(text, SEPARATORS[0]))
    for separator in SEPARATORS[1:]:
        found = level(found, separator)
    return found


def merged(parts: Column, size: int) -> Column:
    """Parts in order, joined by blanks as long as no chunk exceeds ``size``; blank ones go, unless all are."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    closed = lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(part) <= size
        joined = stripped(F.concat(acc["now"], F.lit(" "), part))
        return (
            F.when(stripped(part) == "", acc)
            .when(fits, F.struct(acc["done"].alias("done"), joined.alias("now")))
            .otherwise(F.struct(closed(acc).alias("done"), part.alias("now")))
        )

    return let(parts, lambda p: let(F.aggregate(p, start, step, closed), lambda found: F.when(F.size(found) > 0, found).otherwise(p)))


def chunks(text: Column, size: int = 256) -> Column:
    return merged(pieces(text, size), size)


def intent(text: Column) -> Column:
    """Of the first lines that are not blank the first one with an intent word in it (anywhere, in any case), else the first one."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != ""), 1, INTENT_LINES)
    asks = lambda x: F.lower(x).rlike("|".join(INTENT_WORDS))
    return let(lines, lambda x: F.substring(F.coalesce(F.get(F.filter(x, asks), 0), F.get(x, 0), F.lit("")), 1, INTENT_LENGTH))


def hashed(text: Column) -> Column:
    """The text's words as places of a vector of 4096 counts: three hexadecimal digits of their digests."""
    return F.transform(words(text), lambda w: F.substring(F.sha2(w, 256), 1, 3))


def squares(w: Column) -> Column:
    """The sum of squares of how often each word of w occurs."""
    return F.aggregate(run_counts(w), F.lit(0.0), lambda s, n: s + n * n)


def likeness(a: Column, b: Column, squares_of_b: Column | None = None) -> Column:
    """The cosine of two hashed texts' counts; 0 where one has no words. What both hold in common is told by the squares of both together."""
    found = F.struct(squares(a).alias("a"), (squares(b) if squares_of_b is None else squares_of_b).alias("b"), squares(F.concat(a, b)).alias("ab"))
    return let(found, lambda x: F.coalesce(F.try_divide((x["ab"] - x["a"] - x["b"]) / 2, F.sqrt(x["a"] * x["b"])), F.lit(0.0)))


def chosen(scored: Column, least: float) -> Column:
    """Of (chunk, score) those of ``least`` at least; where there is none, the first of the best."""
    best = lambda x: let(F.array_max(F.transform(x, lambda y: y["score"])), lambda top: F.filter(x, lambda c: c["score"] == top))
    return let(F.filter(scored, lambda c: c["score"] >= least), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.slice(best(scored), 1, 1)))


def semantic(text: Column, least: float = 0.30, size: int = 384) -> Column:
    """The text of the chunks that are like its intent, joined by blanks, and how many of how many these are, with their mean score and the others'. A text
    of one chunk stays as it is."""
    rounded = lambda x: F.round(x, 6)
    millionths = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, c: n + F.round(c["score"] * 1e6).cast("long"))
    mean = lambda x: F.coalesce(F.floor(F.try_divide(2 * millionths(x) + F.size(x), 2 * F.size(x))) / 1e6, F.lit(0.0))  # noqa: E731  rounded once
    score = lambda c, asked: let(hashed(c), lambda w: rounded(likeness(w, asked["w"], asked["n"])))
    asked = let(hashed(intent(text)), lambda w: F.struct(w.alias("w"), squares(w).alias("n")))
    scored = let(asked, lambda asked: F.transform(chunks(text, size), lambda c: F.struct(c.alias("chunk"), score(c, asked).alias("score"))))

    def of(x: Column) -> Column:
        several, kept, dropped = F.size(x["scored"]) > 1, x["kept"], F.filter(x["scored"], lambda c: c["score"] < least)
        return F.struct(
            F.when(several, F.array_join(F.transform(kept, lambda c: c["chunk"]), " ")).otherwise(text).alias("text"), F.size(x["scored"]).cast("long").alias("chunks"),
            F.when(several, F.size(kept)).otherwise(F.size(x["scored"])).cast("long").alias("kept"), F.when(several, rounded(1 - F.size(kept) / F.size(x["scored"]))).otherwise(0.0).alias("dropped_ratio"),
            F.when(several, mean(kept)).otherwise(0.0).alias("score_kept"), F.when(several, mean(dropped)).otherwise(0.0).alias("score_dropped"),
        )

    return let(let(scored, lambda s: F.struct(s.alias("scored"), chosen(s, least).alias("kept"))), of)


def semantic_stage(docs: DataFrame, least: float = 0.30, size: int = 384) -> DataFrame:
    """docs (doc_id, t) with what ``semantic`` makes of each text."""
    return docs.select("doc_id", semantic(F.col("t"), least, size).alias("x")).select("doc_id", "x.*")

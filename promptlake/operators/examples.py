"""Blocks of examples in prompts: found by a running state over lines, reduced to few different ones by leader clusters within a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clusters as cl
from .chunks import stripped

# What opens a block of examples.
MARKERS = r"for\s+example|for\s+instance|e\.g\.|such\s+as|example:|examples:"


def examples(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0) and example of each one in docs (doc_id, t). A line with a marker opens a block, and what follows its first marker, up to the
    next one, is an example unless it is blank; then each line is one, up to a blank line or one that begins with #."""
    lines = docs.select("doc_id", F.posexplode(F.split("t", "\n", -1)).alias("line", "text")).withColumn("text", stripped(F.col("text")))
    opens = F.col("text").rlike(rf"(?iU)\b({MARKERS})\b")
    ends = ~opens & ((F.col("text") == "") | F.col("text").startswith("#"))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when: F.coalesce(F.max(F.when(when, F.col("line"))).over(upto), F.lit(-1))
    marked = lines.select("doc_id", "line", "text", opens.alias("opens"), (last(opens) > last(ends)).alias("inside"))
    after = stripped(F.coalesce(F.get(F.split("text", rf"(?iU)\b({MARKERS})\s*", -1), 1), F.lit("")))
    found = marked.select("doc_id", "line", F.when(F.col("opens"), after).when(F.col("inside"), F.col("text")).otherwise("").alias("example"))
    return found.filter("example <> ''")


def judged(found: DataFrame, most: int = 3, percent: int = 70) -> DataFrame:
    """Of each example of found (doc_id, line, example) the doc_id, the line, ``leader``, the line of the first example of its cluster, and ``stays``: all
    where a text has ``most`` at most, else the first ``most`` leaders."""
    led = cl.grouped(found.select(F.struct("doc_id", "line").alias("node"), F.col("example").alias("text"), "doc_id"), percent, scope=F.col("doc_id"))
    led = led.select("node.doc_id", "node.line", F.col("leader.line").alias("leader"))
    whole = Window.partitionBy("doc_id")
    first = F.count_if(F.col("leader") == F.col("line")).over(whole.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    stays = (F.count("*").over(whole) <= most) | ((F.col("leader") == F.col("line")) & (first <= most))
    return led.withColumn("stays", stays)


def chosen(found: DataFrame, most: int = 3, percent: int = 70) -> DataFrame:
    """found (doc_id, line, example) as judged()."""
    return found.join(judged(found, most, percent), ["doc_id", "line"])


def reduced(docs: DataFrame, most: int = 3, percent: int = 70, protected: Column | None = None) -> DataFrame:
    """doc_id, the text of docs (doc_id, t) without lines of examples that go, and how many went; lines with a placeholder (``protected``: what it begins
    with) stay."""
    mark = F.lit("PROTECTED_") if protected is None else protected
    goes = judged(examples(docs), most, percent).filter(~F.col("stays")).groupBy("doc_id").agg(F.collect_set("line").alias("goes"))
    joined = docs.join(goes, "doc_id", "left").withColumn("goes", F.coalesce("goes", F.array().cast("array<int>")))
    lines = F.split("t", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("goes", i) | F.contains(x, mark))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).cast("long").alias("removed"))

"""Queries of chunking and choice by intent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..sources import tables as t
from .registry import query
from .texts import _SHINGLES

_SPACE = r"[\s\x0B]+"
_WORDS = "list_filter(regexp_split_to_array({0}, '" + _SPACE + "'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _pieces(text: str, size: int) -> str:
    def cut(x: str, separator: str) -> str:
        if separator != " ":
            return f"string_split({x}, '{separator}')"
        return f"list_transform({_WORDS.format(x)}, lambda w, i: CASE WHEN i < len({_WORDS.format(x)}) THEN w || ' ' ELSE w END)"

    found = f"CASE WHEN {text} = '' THEN [] ELSE {cut(text, ch.SEPARATORS[0])} END"
    for separator in ch.SEPARATORS[1:]:
        found = f"flatten(list_transform({found}, lambda p: CASE WHEN length(p) > {size} THEN {cut('p', separator)} ELSE [p] END))"
    return found


def _chunks(text: str, size: int) -> str:
    """The fold over a text: chunks so far between marks, the last one open."""
    mark = "chr(1)"
    now = f"string_split(acc, {mark})[-1]"
    done = f"substr(acc, 1, length(acc) - length({now}))"
    step = f"CASE WHEN length({now}) + length(c) <= {size} THEN {done} || {_strip(f'{now} || chr(32) || c')} WHEN {now} = '' THEN {done} || c ELSE acc || {mark} || c END"
    fold = f"list_reduce(list_prepend('', list_filter(p, lambda c: {_strip('c')} <> '')), lambda acc, c: {step})"
    return f"(SELECT CASE WHEN f = '' THEN p ELSE string_split(f, {mark}) END FROM (SELECT p, {fold} AS f FROM (SELECT {_pieces(text, size)} AS p) a) b)"


@query(f"SELECT doc_id, unnest(c) AS chunk, CAST(generate_subscripts(c, 1) - 1 AS INT) AS position FROM (SELECT doc_id, {_chunks('text', 256)} AS c FROM documents WHERE text IS NOT NULL) x")
def g10_chunks(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", F.posexplode(ch.chunks(F.col("text"))).alias("position", "chunk"))


_LINES = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[:{ch.INTENT_LINES}]"
_INTENT = f"substr(coalesce(list_filter({_LINES}, lambda x: regexp_matches(lower(x), '{'|'.join(ch.INTENT_WORDS)}'))[1], ({_LINES})[1], ''), 1, {ch.INTENT_LENGTH})"


@query(f"SELECT doc_id, {_INTENT} AS intent FROM ({t.PHRASED_SQL}) x")
def g11_task_intents(spark: SparkSession, d: str) -> DataFrame:
    return t.phrased_documents(spark, d).select("doc_id", ch.intent(F.col("t")).alias("intent"))


_HASHED = "list_transform(" + _SHINGLES.replace("text", "{0}") + ", lambda w: substr(sha256(w), 1, 3))"
_BOTH = "coalesce(list_sum(list_transform({0}, lambda x: len(list_filter({1}, lambda y: y = x)))), 0)"


_MEAN = "floor((2 * sum(CAST(round(score * 1e6) AS BIGINT)) FILTER ({0}) + count(*) FILTER ({0})) / CAST(2 * count(*) FILTER ({0}) AS DOUBLE)) / 1e6"


@query(f"""WITH cut AS (SELECT doc_id, t, {_chunks('t', 384)} AS c, {_HASHED.format(_INTENT)} AS asked FROM ({t.PHRASED_SQL}) x),
rows AS (SELECT doc_id, t, len(c) AS n, asked, unnest(c) AS chunk, generate_subscripts(c, 1) AS i FROM cut),
scored AS (SELECT doc_id, t, n, i, chunk, round(coalesce({_BOTH.format('h', 'asked')} / nullif(sqrt(CAST({_BOTH.format('h', 'h')} AS DOUBLE) * {_BOTH.format('asked', 'asked')}), 0), 0), 6) AS score FROM (SELECT *, {_HASHED.format('chunk')} AS h FROM rows) y),
judged AS (SELECT *, n = 1 OR score >= 0.3 OR (max(score) OVER (PARTITION BY doc_id) < 0.3 AND row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1) AS stays FROM scored)
SELECT doc_id, CASE WHEN n = 1 THEN any_value(t) ELSE string_agg(chunk, ' ' ORDER BY i) FILTER (stays) END AS text, n AS chunks, count(*) FILTER (stays) AS kept, CASE WHEN n = 1 THEN 0 ELSE round(1 - count(*) FILTER (stays) / CAST(n AS DOUBLE), 6) END AS dropped_ratio,
CASE WHEN n = 1 THEN 0 ELSE {_MEAN.format('stays')} END AS score_kept, CASE WHEN n = 1 THEN 0 ELSE coalesce({_MEAN.format('score < 0.3')}, 0) END AS score_dropped FROM judged GROUP BY doc_id, n""")
def g12_g13_chunks_like_the_intent(spark: SparkSession, d: str) -> DataFrame:
    return ch.semantic_stage(t.phrased_documents(spark, d))

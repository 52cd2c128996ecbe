"""What changes between two versions of a prompt: tokens, cost, risk, and hunks of lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import PRICES
from .measures import approximate_tokens, words

# Words whose loss is a high risk, the share of output in input tokens, ratios of lengths below which the risk is high or medium.
CRITICAL = ("not", "never", "must", "required", "pas", "jamais", "obligatoire")
OUTPUT_SHARE, HIGH, MEDIUM = 0.3, 0.5, 0.75

HUNK = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a_from", "a_to", "b_from", "b_to")] + [T.StructField("lines", T.ArrayType(T.StringType()))])


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that occur once in each of a and b, as many as are in the same order in both."""
    once = [{x for x, n in Counter(side).items() if n == 1} for side in (a, b)]
    place = {x: j for j, x in enumerate(b)}
    pairs = [(i, place[x]) for i, x in enumerate(a) if x in once[0] and x in once[1]]
    tails: list[int] = []  # of the shortest last place for each length, and who comes before whom
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    found, k = [], ends[-1] if ends else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


def hunks(a: list[str], b: list[str]) -> list[dict]:
    """What to put in place of which lines of a to get b. Common ends are set aside, then lines that occur once cut what is left, and so on."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
        if i == m and j == n:
            continue
        cuts = anchors(a[i:m], b[j:n]) if i < m and j < n else []
        if not cuts:
            found.append({"a_from": i, "a_to": m, "b_from": j, "b_to": n, "lines": b[j:n]})
            continue
        edges = [(i - 1, j - 1), *((i + x, j + y) for x, y in cuts), (m, n)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(found, key=lambda h: (h["a_from"], h["b_from"]))


@F.pandas_udf(T.ArrayType(HUNK))
def line_hunks(a: pd.Series, b: pd.Series) -> pd.Series:
    """The hunks between two texts, null as empty; nothing for equal ones."""
    return pd.Series([hunks((x or "").split("\n"), (y or "").split("\n")) for x, y in zip(a, b, strict=True)])


def applied(a: Column, found: Column) -> Column:
    """The second text, from the first and its hunks."""
    lines = F.split(F.coalesce(a, F.lit("")), "\n", -1)
    upto = F.transform(found, lambda h, i: F.concat(F.slice(lines, F.coalesce(F.get(found, i - 1)["a_to"], F.lit(0)) + 1, h["a_from"] - F.coalesce(F.get(found, i - 1)["a_to"], F.lit(0))), h["lines"]))
    last = F.coalesce(F.try_element_at(found, F.lit(-1))["a_to"], F.lit(0))
    return F.array_join(F.concat(F.flatten(upto), F.slice(lines, last + 1, F.size(lines))), "\n")


def compared(a: Column, b: Column, model: str = "gpt-4o") -> list[Column]:
    """Tokens and cost of both with their differences, the ratio of lengths, the words that matter and are lost, and the risk."""
    _, price_in, price_out = PRICES[model]
    tokens = [approximate_tokens(x) for x in (a, b)]
    cost = [n / 1000.0 * price_in + F.floor(n * OUTPUT_SHARE) / 1000.0 * price_out for n in tokens]
    ratio = F.length(F.coalesce(b, F.lit(""))) / F.greatest(F.length(F.coalesce(a, F.lit(""))), F.lit(1))
    lost = F.array_sort(F.array_intersect(F.array_except(words(a), words(b)), F.array(*map(F.lit, CRITICAL))))
    risk = F.when((F.size(lost) > 0) | (ratio < HIGH), "high").when(ratio < MEDIUM, "medium").otherwise("low")
    percent = F.round((tokens[1] - tokens[0]) / F.greatest(tokens[0], F.lit(1)) * 100, 1)
    return [
        tokens[0].alias("tokens_a"), tokens[1].alias("tokens_b"), (tokens[1] - tokens[0]).alias("token_delta"), percent.alias("token_delta_percent"), F.round(cost[0], 6).alias("cost_a_usd"),
        F.round(cost[1], 6).alias("cost_b_usd"), F.round(cost[1] - cost[0], 6).alias("cost_delta_usd"), F.round(ratio, 2).alias("length_ratio"), risk.alias("risk"), F.array_join(lost, ",").alias("lost_words"),
    ]

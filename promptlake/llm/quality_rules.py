"""Quality rules: robust multivariate outliers among per-document text statistics.

Every document is reduced to a vector of transformed statistics. For each language and source, and for each
language alone, the minimum covariance determinant (MCD) estimate of centre and scatter is found by concentration
steps; a document goes when its squared Mahalanobis distance from its group's estimate passes a cut-off. All of it
is DataFrame operations: statistics by array functions, concentration steps by grouped sums, and the distance by a
Cholesky factor written out as column expressions.

Defined cases: null text counts as no words and fails the base rule; null language or source form groups of their
own; repeated rows are counted and judged row by row; groups under ``min_rows`` use the language's estimate, and
languages under ``min_rows`` only the base rule; an empty table gives an empty result; further columns of the
input pass through nothing and clash with nothing, as only the id, text, language and source columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_SET, broadcast_if_small, documents, let, materialize

#: Name, transformed value, and the least standard deviation that scatter estimates are given for it.
FEATURES = (
    ("ln_words", "ln(greatest(n_words, 1))", 0.3),
    ("ln_word_length", "ln(greatest(try_divide(word_chars, n_words), 1.0D))", 0.06),
    ("symbols", "log1p(100 * try_divide(n_symbols, word_chars))", 0.25),
    ("dup_lines", "try_divide(n_dup_lines, n_lines)", 0.12),
    ("repeats", "try_divide(n_repeat_words, n_words)", 0.12),
    ("upper", "try_divide(n_upper, word_chars)", 0.05),
    ("marks", "log1p(100 * try_divide(n_marks, word_chars))", 0.5),
)
P = len(FEATURES)
#: Quantiles of the chi-squared distribution with P = 7 degrees of freedom: the median and the cut-off (1 - 1e-9).
CHI2_MEDIAN, CHI2_CUT = 6.3458, 55.0
FEW = 32


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that the text holds at least twice, from an array of at least 3 words."""
    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def by_list(hashes: Column, repeated: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - 1)
        return covered(F.filter(at, lambda i: F.array_contains(repeated, F.get(hashes, i))))

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        found = let(pairs, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
        return covered(F.sort_array(F.transform(found, lambda x: x["i"])))

    def from_hashes(hashes: Column) -> Column:
        ordered = F.sort_array(hashes)
        repeated = let(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))
        by_count = lambda r: F.when(F.size(r) <= FEW, by_list(hashes, r)).otherwise(by_sort(hashes))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(repeated, by_count))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, from_hashes)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' id, language and source with the counts of the base rule and those that the vector adds."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_SET))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_SET))) > 0)
    only = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", "")).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) >= 4, _repeat_words(w)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return docs.select(
        "doc_id", "lang", "source",
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
        only("#*$%&|<>").alias("n_symbols"), only(r"\p{Lu}").alias("n_upper"), only("!?").alias("n_marks"),
    ).select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols", "n_upper", "n_marks")


def _x(i: int) -> Column:
    return F.col(f"x{i}")


def _cholesky(params: DataFrame) -> DataFrame:
    """From means m_i and covariances c_i_j (j <= i): the lower factor's entries l_i_j, one column after the other."""
    for j in range(P):
        done = [F.col(f"l_{j}_{k}") ** 2 for k in range(j)]
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(reduce(lambda a, b: a - b, done, F.col(f"c_{j}_{j}")), F.lit(1e-9))))
        below = {}
        for i in range(j + 1, P):
            done = [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
            below[f"l_{i}_{j}"] = reduce(lambda a, b: a - b, done, F.col(f"c_{i}_{j}")) / F.col(f"l_{j}_{j}")
        params = params.withColumns(below) if below else params
    return params.withColumn("ln_det", reduce(lambda a, b: a + b, [2 * F.log(f"l_{j}_{j}") for j in range(P)]))


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, by forward substitution, to rows that carry x_i, m_i and l_i_j."""
    for i in range(P):
        done = [F.col(f"l_{i}_{k}") * F.col(f"y{k}") for k in range(i)]
        rows = rows.withColumn(f"y{i}", reduce(lambda a, b: a - b, done, _x(i) - F.col(f"m{i}")) / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") ** 2 for i in range(P)])).drop(*[f"y{i}" for i in range(P)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and floored covariances of rows' x_i by keys."""
    sums = [F.count("*").alias("n_used")] + [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)]
    sums += [F.avg(_x(i) * _x(j)).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums)
    floor = lambda i, j: FEATURES[i][2] ** 2 if i == j else 0.0
    return out.select(*keys, "n_used", *[f"m{i}" for i in range(P)], *[(F.col(f"s_{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") + floor(i, j)).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)])


def mcd_estimates(vectors: DataFrame, share: float = 0.75, steps: int = 3, min_rows: int = 100) -> DataFrame:
    """MCD centre (m_i) and Cholesky factor (l_i_j) of each group g of vectors (g, x0, ...), scaled so that the median
    squared distance is the chi-squared median.

    Two deterministic starts (distances from the coordinate medians in units of the median absolute deviation: their
    sum of squares, and the largest) are concentrated ``steps`` times: the ``share`` of the group's rows that lie
    nearest give the next centre and scatter. The start with the smaller determinant wins.
    """
    middle = materialize(vectors.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"med{i}") for i in range(P)]).filter(F.col("n") >= min_rows), "mcd-middle")
    groups = middle.count()
    centred = vectors.join(broadcast_if_small(middle, groups), "g")
    mad = centred.groupBy("g").agg(*[F.greatest(1.4826 * F.percentile_approx(F.abs(_x(i) - F.col(f"med{i}")), 0.5, 10_000), F.lit(FEATURES[i][2])).alias(f"mad{i}") for i in range(P)])
    mad = materialize(mad, "mcd-mad")
    scaled = [F.abs(_x(i) - F.col(f"med{i}")) / F.col(f"mad{i}") for i in range(P)]
    starts = F.array(reduce(lambda a, b: a + b, [s * s for s in scaled]), F.greatest(*scaled))
    rows = centred.join(broadcast_if_small(mad, groups), "g").select("g", *[f"x{i}" for i in range(P)], F.posexplode(starts).alias("start", "d2"))
    keys = ["g", "start"]
    for step in range(steps + 1):
        cut = materialize(rows.groupBy(*keys).agg(F.percentile_approx("d2", share, 10_000).alias("cut")), "mcd-cut")
        near = rows.join(broadcast_if_small(cut, 2 * groups), keys).filter(F.col("d2") <= F.col("cut"))
        params = materialize(_cholesky(_moments(near, keys)), "mcd-params")
        if step == steps:
            best = params.groupBy("g").agg(F.min_by(F.struct(*[c for c in params.columns if c != "g"]), F.struct("ln_det", "start")).alias("best")).select("g", "best.*")
            params, keys = materialize(best, "mcd-best"), ["g"]
            spread = vectors
        else:
            spread = vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
        rows = _with_distance(spread.join(broadcast_if_small(params, 2 * groups), keys)).select(*keys, *[f"x{i}" for i in range(P)], "d2")
    scale = rows.groupBy("g").agg(F.greatest(F.percentile_approx("d2", 0.5, 10_000) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    return materialize(params.join(scale, "g"), "mcd-scaled")


def _key(*names: str) -> Column:
    """A string for the values, nulls told apart from any text."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), n), F.lit("~")) for n in names])


def quality_rules(docs: DataFrame, cut: float = CHI2_CUT, min_rows: int = 100) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): the counts, base_failed, distance (of the row's vector;
    null without an estimate) and kept."""
    stats = text_statistics(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    stats = materialize(stats.select("*", *[F.coalesce(F.expr(v), F.lit(0.0)).alias(f"x{i}") for i, (_, v, _) in enumerate(FEATURES)]), "quality-statistics")
    fine, coarse = _key("lang", "source"), _key("lang")
    vectors = stats.filter(~F.col("base_failed")).select(F.explode(F.array(fine, coarse)).alias("g"), *[f"x{i}" for i in range(P)])
    estimates = mcd_estimates(vectors, min_rows=min_rows)
    n = estimates.count()
    known = broadcast_if_small(estimates.select("g").withColumn("known", F.lit(True)), n)
    chosen = stats.withColumns({"fine": fine, "coarse": coarse}).join(known.withColumnRenamed("g", "fine"), "fine", "left")
    chosen = chosen.withColumn("g", F.when(F.col("known"), F.col("fine")).otherwise(F.col("coarse")))
    measured = _with_distance(chosen.join(broadcast_if_small(estimates, n), "g", "left"))
    distance = F.col("d2") / F.col("scale")
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(distance <= cut, F.lit(True))).alias("kept"), distance.alias("distance"), "n_lines", "n_upper", "n_marks",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))

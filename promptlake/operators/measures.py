"""Token counts, entropy, compression measures, gates and judges, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-case words between white space; none of a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def approximate_tokens(text: Column) -> Column:
    def of(text: Column) -> Column:
        t = F.trim(text)
        n = F.floor(F.regexp_count(t, F.lit(r"[A-Za-z0-9_]+")) * 1.3 + F.length(F.regexp_replace(t, r"[A-Za-z0-9_\s]+", "")) * 0.5)  # runs are skipped faster than other characters are found
        return F.when(F.length(text) == 0, 0).otherwise(F.greatest(n, F.lit(1)))

    return let(F.coalesce(text, F.lit("")), of).cast("long")


def tokens_by_provider(text: Column, provider: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    a = F.greatest(F.floor(F.floor(n / 3.5) * 1.1), F.lit(1))
    return F.when(provider == "anthropic", a).when(provider == "google", F.greatest(F.floor(n / 4), F.lit(1))).otherwise(approximate_tokens(text)).cast("long")


def quarter_tokens(text: Column) -> Column:
    return F.greatest(F.floor(F.length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("long")


def ngrams(w: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def hashed_ngrams(w: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.slice(w, i + 1, n)))


def run_counts(items: Column) -> Column:
    """How often each distinct item occurs: lengths of the runs of the sorted items."""
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    return let(F.sort_array(items), lambda s: let(ends(s), lambda e: F.transform(e, lambda x, k: x - F.when(k == 0, 0).otherwise(F.get(e, k - 1)))))


def numbered(items: Column) -> Column:
    """The items in order, each with its number among its equals: multisets as sets."""
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))

    def of(s: Column) -> Column:
        def runs(e: Column) -> Column:
            begin = lambda k: F.when(k == 0, 0).otherwise(F.get(e, k - 1))
            return F.flatten(F.transform(e, lambda x, k: F.transform(F.sequence(F.lit(1), x - begin(k)), lambda j: F.concat(F.get(s, x - 1), F.lit("\n"), j.cast("string")))))

        return let(ends(s), runs)

    return let(F.sort_array(items), of)


def ngram_entropy(w: Column, order: int) -> Column:
    """Shannon entropy of the n-grams of the words w (bound by let) over the most it could be, within [.1, 1]; 0 without words."""
    n = F.least(F.lit(order), F.greatest(F.size(w) - 1, F.lit(1)))

    def of(g: Column) -> Column:
        total = F.size(g).cast("double")
        bits = F.aggregate(run_counts(g), F.lit(0.0), lambda a, c: a - c / total * F.log2(c / total))
        return F.greatest(F.least(bits / F.log2(F.greatest(total, F.lit(2.0))), F.lit(1.0)), F.lit(0.1))

    return F.when(F.size(w) == 0, 0.0).otherwise(let(hashed_ngrams(w, n), of))


def redundancy(w: Column) -> Column:
    ratio = F.size(F.array_distinct(w)) / F.greatest(F.sqrt(F.size(w).cast("double")), F.lit(1.0))
    return F.when(F.size(w) == 0, 1.0).otherwise(F.greatest(1.0 - F.least(ratio / 3.0, F.lit(1.0)), F.lit(0.0)))


def headroom(n_words: Column, entropy: Column, redundant: Column, protected: Column) -> Column:
    """What a text leaves to compress; nothing where it has no words."""
    footprint = entropy * (1.0 - redundant) + protected * 0.5
    return F.when(n_words == 0, 0.0).otherwise(1.0 - F.greatest(F.least(footprint, F.lit(1.0)), F.lit(0.0)))


def quenching_floor(entropy: Column, protected: Column) -> Column:
    return F.greatest(F.least(0.10 + entropy * 0.20 + protected * 0.15, F.lit(0.50)), F.lit(0.05))


def safe_threshold(entropy: Column, protected: Column) -> Column:
    base = F.when(entropy < 0.4, 0.3).when(entropy < 0.6, 0.4).otherwise(0.5)
    return F.greatest(F.least(base + protected * 0.3, F.lit(0.95)), F.lit(0.15))


def compression(original: Column, compressed: Column) -> Column:
    """Ratio, characters and tokens saved of a compressed text."""
    a, b = quarter_tokens(original), quarter_tokens(compressed)
    return F.struct(F.round(1 - b / a, 6).alias("reduction"), (F.length(original) - F.length(compressed)).cast("long").alias("chars_saved"), (a - b).alias("tokens_saved"))


def explain(original_tokens: Column, optimized_tokens: Column) -> Column:
    saved = F.round((1 - optimized_tokens / F.greatest(original_tokens, F.lit(1))) * 100, 1)
    return F.struct(saved.alias("savings_percent"), F.when(saved < 50, "low").when(saved < 65, "medium").otherwise("high").alias("risk"), F.when(saved > 30, "deploy").otherwise("marginal").alias("recommendation"))


def factual_elements(text: Column) -> Column:
    """Dates, numbers, addresses, links and names, each with its kind in front."""
    # fixed values
    kinds = (
        ("date:", r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"),
        ("number:", r"\b\d+(?:[.,]\d+)?\s*(?:%|€|\$|£|M|k|K|millions?|milliards?)\b|\b\d[\d,]*\d\b"),
        ("email:", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
        ("url:", r"https?://\S+"),
        ("entity:", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"),
    )
    found = [F.transform(F.regexp_extract_all(text, F.lit(f"(?U)({p})"), F.lit(1)), lambda x, k=k: F.concat(F.lit(k), x)) for k, p in kinds]
    return F.array_distinct(F.concat(*found))


def factual_loss(original: Column, compressed: Column) -> Column:
    """Share of the original's factual elements that the compressed text lacks."""
    of = lambda a: let(factual_elements(compressed), lambda b: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_except(a, b)) / F.size(a)))
    return let(factual_elements(original), of)


def retry(loss: Column, gained: Column) -> Column:
    """Whether an answer should be asked for again: too much was lost, and less was gained."""
    return (loss > 0.15) & (gained < loss)


def novelty(text: Column) -> Column:
    n = F.size(words(text))
    return F.when(n == 0, 0.0).otherwise(F.least(F.regexp_count(text, F.lit(rules.pattern(rules.TRANSITIONS))) / F.greatest(n * 0.1, F.lit(1.0)), F.lit(1.0)))


def judge(a: Column, b: Column) -> Column:
    """Five similarities of two answers and their weighted score."""
    marks = lambda t: F.length(F.regexp_replace(t, "[^.!?]+", "")) + 1
    split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    pairs = lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(ngrams(w, F.lit(2))))
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))

    def scored(s: Column) -> Column:
        la, lb = F.size(s["a"]), F.size(s["b"])
        low = lambda w: F.transform(w, lambda x: F.lower(x))
        jaccard = share(low(s["a"]), low(s["b"]))
        complete = F.least(lb / F.greatest(la, F.lit(1)), F.lit(1.0)) * 0.8 + jaccard * 0.2
        coherent = share(pairs(s["a"]), pairs(s["b"])) * 0.7 + jaccard * 0.3
        only_b = F.size(F.array_except(low(s["b"]), low(s["a"])))
        faithful = F.greatest(1.0 - only_b / F.greatest(F.size(F.array_distinct(low(s["b"]))), F.lit(1)), F.lit(0.0))
        xa, xb = la / marks(s["ta"]), lb / marks(s["tb"])
        style = 1.0 - F.least(F.abs(xa - xb) / F.greatest(xa + xb, F.lit(1.0)), F.lit(1.0))
        total = jaccard * 0.30 + complete * 0.25 + coherent * 0.20 + faithful * 0.15 + style * 0.10
        score = F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)) * F.when(lb < la * 0.3, 0.7).otherwise(1.0)
        r = lambda c, n: F.round(c, n)
        return F.struct(r(jaccard, 6).alias("accuracy"), r(complete, 6).alias("completeness"), r(coherent, 6).alias("coherence"), r(faithful, 6).alias("faithfulness"), r(style, 6).alias("style"), r(score, 6).alias("score"))

    names = ("accuracy", "completeness", "coherence", "faithfulness", "style")
    unknown = F.struct(*[F.lit(None).cast("double").alias(n) for n in names], F.lit(0.5).alias("score"))
    empty = (F.length(F.coalesce(a, F.lit(""))) == 0) | (F.length(F.coalesce(b, F.lit(""))) == 0)
    return F.when(empty, unknown).otherwise(let(F.struct(split(a).alias("a"), split(b).alias("b"), a.alias("ta"), b.alias("tb")), scored))


def oracle_gate(j: Column) -> Column:
    """All five dimensions above their thresholds: score 1, else the least dimension; those of an empty answer are 0."""
    of = {k: F.coalesce(j[k], F.lit(0.0)) for k in ("accuracy", "completeness", "coherence", "faithfulness", "style")}
    least = {"accuracy": 0.80, "completeness": 0.75, "coherence": 0.70, "faithfulness": 0.85, "style": 0.60}
    failed = F.filter(F.array(*[F.when(of[k] < v, F.lit(k)) for k, v in least.items()]), lambda x: x.isNotNull())
    return F.struct((F.size(failed) == 0).alias("passed"), F.when(F.size(failed) == 0, 1.0).otherwise(F.least(*[of[k] for k in least])).alias("gate_score"), F.array_join(failed, ",").alias("failed"))


def bleu(reference: Column, hypothesis: Column) -> Column:
    """BLEU-4: clipped n-gram precisions' geometric mean times the brevity penalty."""
    def precision(w: Column, n: int) -> Column:
        grams = lambda x: numbered(ngrams(x, F.lit(n)))
        short = (F.size(w["h"]) < n) | (F.size(w["r"]) < n)
        return F.when(short, 0.0).otherwise(F.size(F.array_intersect(grams(w["h"]), grams(w["r"]))) / (F.size(w["h"]) - n + 1))

    def of(w: Column) -> Column:
        logs = [F.log(F.greatest(precision(w, n), F.lit(1e-10))) for n in (1, 2, 3, 4)]
        brevity = F.least(F.exp(1 - F.size(w["r"]) / F.greatest(F.size(w["h"]), F.lit(1))), F.lit(1.0))
        return F.when((F.size(w["r"]) == 0) | (F.size(w["h"]) == 0), 0.0).otherwise(brevity * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4.0))

    return let(F.struct(words(reference).alias("r"), words(hypothesis).alias("h")), of)


@F.pandas_udf(T.IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two lists: the row of the table of lengths is an integer, a bit per item of b that is 0 where
    the length grows."""
    def of(x, y) -> int | None:
        if x is None or y is None:
            return None
        at: dict[str, int] = {}
        for j, w in enumerate(y):
            at[w] = at.get(w, 0) | 1 << j
        full = row = (1 << len(y)) - 1
        for w in x:
            met = row & at.get(w, 0)
            if met:
                row = (row + met | row - met) & full
        return len(y) - row.bit_count()

    return pd.Series([of(*x) for x in zip(a, b)], dtype="Int32")


def rouge_l(reference: Column, hypothesis: Column) -> Column:
    """F1 of the longest common subsequence of words."""
    r, h = words(reference), words(hypothesis)
    common = longest_common(r, h)
    p, q = common / F.size(h), common / F.size(r)
    return F.when((F.size(r) == 0) | (F.size(h) == 0) | (common == 0), 0.0).otherwise(2 * p * q / (p + q))


#: Structures that must not be lost altogether.
STRUCTURES = (
    ("code_fence", r"(?s)```\w*\n.*?\n```"), ("json_block", r"(?s)\{.*?\}"), ("latex_display", r"(?s)\$\$.*?\$\$"),
    ("yaml_frontmatter", r"(?s)---.*?---"), ("markdown_table", r"\|[^\n]+\|[^\n]+\|"),
)


def integrity(original: Column, compressed: Column) -> Column:
    """Gate on what compression leaves: token ratio, entropy, structures, and a text of three characters at least."""
    def of(w: Column) -> Column:
        ratio = F.size(w["c"]) / F.greatest(F.size(w["o"]), F.lit(1))
        collapse = (F.size(w["c"]) == 0) | (F.coalesce(F.try_divide(ngram_entropy(w["c"], 3), ngram_entropy(w["o"], 3)) < 0.20, F.lit(False)))
        empty = F.length(F.trim(w["tc"])) < 3
        gone = F.array_compact(F.array(*[F.when(w["to"].rlike(p) & ~w["tc"].rlike(p), F.lit(n)) for n, p in STRUCTURES]))
        lost = F.when((F.size(w["o"]) > 0) & (F.size(w["c"]) > 0), let(gone, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("structure lost: "), F.array_join(x, ",")))))
        why = F.concat_ws("; ", F.when(ratio < 0.15, "token ratio"), F.when(collapse, "entropy collapse"), lost, F.when(empty, "empty"))
        return let(why, lambda why: F.struct((why == "").alias("passed"), F.round(ratio, 4).alias("token_ratio"), why.alias("reason")))

    original, compressed = F.coalesce(original, F.lit("")), F.coalesce(compressed, F.lit(""))
    split = lambda x: F.struct(words(x["to"]).alias("o"), words(x["tc"]).alias("c"), x["to"].alias("to"), x["tc"].alias("tc"))
    return let(let(F.struct(original.alias("to"), compressed.alias("tc")), split), of)

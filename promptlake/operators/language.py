"""Detection, features, protection and compression of prompts: column expressions, and small helpers inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon, rules, spans
from ..sources.tables import PROFILE_OF_RATE, lookup
from ..storage import written
from . import text as tx
from .measures import let, words


def format_of_name(name: Column) -> Column:
    """File format by the suffix of a name; text where it is unknown."""
    return F.coalesce(lookup(lexicon.FORMATS, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))), F.lit("txt"))


def language(text: Column) -> Column:
    """fr where French words are more than English ones and more than one, else en."""
    count = lambda x: F.regexp_count(text, F.lit(rules.pattern(x)))
    fr = count(lexicon.FRENCH)
    return F.when((fr > count(lexicon.ENGLISH)) & (fr > 1), "fr").otherwise("en")


def text_type(text: Column, fmt: Column, lang: Column) -> Column:
    """The kind of a text: the first rule that applies."""
    code = r"(?i)(def |class |function |import |from |public\s+(class|void|int|string))"
    return (
        F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 50, "short").when((fmt == "code") | text.rlike(code), "code").when(fmt == "json", "json")
        .when(text.rlike(r"(?i)(Speaker|Participant|Agent)\s*[0-9]+\s*:"), "meeting").when(text.rlike(r"(?iU)\b(Article|Section|Clause|CONTRAT|CONVENU)"), "legal")
        .when(lang != "en", "multilingual").otherwise("general")
    )


def max_profile(cap: Column) -> Column:
    """The name of the greatest rate up to the cap."""
    out = F.lit("bypass")
    for rate, name in sorted(PROFILE_OF_RATE.items()):
        out = F.when(cap >= rate, name).otherwise(out)
    return out


def stance(sentence: Column) -> Column:
    out = None
    for name, phrases in lexicon.STANCES_EN:
        hit = sentence.rlike(rules.pattern(phrases))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def has_negation(text: Column) -> Column:
    return text.rlike(rules.pattern(rules.NEGATION_CUES_EN)) | text.rlike(rules.pattern(rules.NEGATION_CONTRACTED_EN))


def has_affixal_negation(text: Column) -> Column:
    return text.rlike(rules.pattern(lexicon.AFFIXES))


def negated_segments(text: Column) -> Column:
    """The sentences that hold a cue of negation."""
    return F.transform(F.filter(tx.sentences(text), lambda s: has_negation(s)), lambda s: F.trim(s))


def mark_negated(text: Column) -> Column:
    """Cues of negation between marks, list after list."""
    for phrases in (rules.NEGATION_CUES_EN, rules.NEGATION_CONTRACTED_EN):
        text = F.regexp_replace(text, rules.pattern(phrases), "¬$1¬")
    return text


def unmark_negated(text: Column) -> Column:
    return F.replace(text, F.lit("¬"), F.lit(""))


def consolidate_negations(text: Column, mark: Column | None = None) -> Column:
    """The text in lower case but for placeholders (mark and number), double negations said outright."""
    mark = F.lit("PROTECTED_") if mark is None else mark
    text = F.lower(text)
    for old, new in lexicon.DOUBLE_NEGATIONS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, F.concat(F.lower(mark), F.lit(r"(\d+)")), F.concat(mark, F.lit("$1")))


def without_request_talk(text: Column) -> Column:
    """Without phrases about the request, and without thanks up to the sentence's end."""
    text = tx.in_stretches(text, [(rules.pattern(re.escape(phrase).replace(r"\ ", " ")), "") for phrase in lexicon.ABOUT_THE_REQUEST])
    thanks = [(rf"(?iU)\b{rules.spaced(phrase)}[^.!?]*[.!?]?", "") for phrase in lexicon.THANKS]
    any_thanks = rf"(?iU)\b(?:{'|'.join(map(rules.spaced, lexicon.THANKS))})"
    return let(text, lambda x: F.when(x.rlike(any_thanks), tx.chain(x, thanks)).otherwise(x))


def without_cancelled(sentences: Column) -> Column:
    """A sentence that takes back the one before removes it, and leaves of itself what comes before the phrase."""
    pattern = rules.pattern(lexicon.CANCELLED)

    def step(kept: Column, s: Column) -> Column:
        head = F.trim(F.get(F.split(s, pattern, 2), 0))
        rest = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(s.rlike(rules.any_of([pattern])), F.when(head == "", rest).otherwise(F.concat(rest, F.array(head)))).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(sentences, F.array().cast("array<string>"), step)


def without_repeats(sentences: Column, most: float = 0.6) -> Column:
    """Without sentences whose words agree with the last one kept by more than ``most``."""
    bag = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)(\w+)"), F.lit(1)))

    def step(held: Column, x: Column) -> Column:
        a, b = F.size(held["last"]), F.size(x["bag"])
        # bags without doubles: their union is told by their sizes and what they share, and can be told to be too large by their sizes alone
        near = lambda n: n > most * (a + b - n)
        again = (a > 0) & (b > 0) & (F.least(a, b) > most * F.greatest(a, b)) & let(F.size(F.array_intersect(held["last"], x["bag"])), near)
        return F.when(again, held).otherwise(F.struct(F.concat(held["kept"], F.array(x["s"])).alias("kept"), x["bag"].alias("last")))

    none = F.array().cast("array<string>")
    told = F.transform(sentences, lambda s: F.struct(s.alias("s"), bag(s).alias("bag")))
    return F.aggregate(told, F.struct(none.alias("kept"), none.alias("last")), step, lambda held: held["kept"])


def _keyword(word: str) -> str:
    """A Java pattern of a keyword with no letter, digit or underscore on either side."""
    return rf"(?iU)(?<!\w){re.escape(word)}(?!\w)"


def _among(found: Column, words: list[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(words)))


def _counted(text: Column, lists: tuple[tuple[str, ...], ...]) -> Column:
    """For each list how many of its phrases a text holds, those listed twice counted twice. Words are looked up among the text's words at
    once; a longer phrase is searched for only where its first word is one of these."""
    single = lambda x: re.fullmatch(r"\w+", x)
    head = lambda x: re.match(r"\w+", x)[0].lower()
    known = sorted({head(x) for phrases in lists for x in phrases})
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: w.isin(known)))

    def counts(held: Column) -> Column:
        def of(phrases: tuple[str, ...]) -> Column:
            words = [x.lower() for x in phrases if single(x)]
            n = F.lit(0)
            for times in sorted({words.count(x) for x in words}):
                n = n + times * _among(held, [x for x in dict.fromkeys(words) if words.count(x) == times])
            for x in phrases:
                if not single(x):
                    n = n + F.when(F.array_contains(held, head(x)), text.rlike(_keyword(x)).cast("int")).otherwise(0)
            return n

        return F.array(*map(of, lists))

    return let(found, counts)


def task(text: Column) -> Column:
    """The task whose keywords occur most; the first on a tie, factuel without any."""
    named = lambda n: F.array(*[F.struct(F.get(n, i).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, name in enumerate(lexicon.TASKS)])
    best = let(_counted(text, tuple(lexicon.TASKS.values())), lambda n: F.array_max(named(n)))
    return let(best, lambda best: F.when(best["n"] > 0, best["name"]).otherwise("factuel"))


def specificity(text: Column) -> Column:
    """How special a text is, by the terms of a trade and the names that it holds."""
    terms = tuple(dict.fromkeys(w for phrases in lexicon.TERMS for w in phrases))
    names = F.regexp_count(text, F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"))
    rule = lambda x: F.when((x["n"] >= 3) | ((x["n"] >= 1) & (x["names"] >= 3)), "entity_rich").when((x["n"] >= 1) | (x["names"] >= 2), "domain_jargon").otherwise("generic")
    return let(F.struct(F.get(_counted(text, (terms,)), 0).alias("n"), names.alias("names")), rule)


def preferences(prompts: DataFrame) -> DataFrame:
    """user_id, kind, value: of each user's prompts (user_id, at, text) the last that tells a preference, by kind."""
    told = F.array(*[F.when(F.col("text").rlike(rules.pattern(p)), F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.lit(i).alias("i"))) for i, (kind, value, p) in enumerate(lexicon.PREFERENCES)])
    found = prompts.select("user_id", "at", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("p"))
    return found.groupBy("user_id", F.col("p.kind").alias("kind")).agg(F.max_by("p.value", F.struct("at", "p.i")).alias("value"))


def user_summaries(found: DataFrame) -> DataFrame:
    """One sentence per user from their preferences."""
    said = {"language": "Writes in ", "tone": "Prefers a tone ", "format": "Favourite format: "}
    by = found.groupBy("user_id").pivot("kind", list(said)).agg(F.first("value"))
    return by.select("user_id", F.concat_ws(". ", *[F.concat(F.lit(v), F.col(k)) for k, v in said.items()]).alias("summary"))


# --- protection


def _spans(patterns: tuple[tuple[str, str], ...], text: str) -> list[tuple[int, int, str]]:
    return sorted((m.start(), m.end(), label) for label, p in patterns for m in re.finditer(p, text))


@F.udf(T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), useArrow=False)
def protected_blocks(text: str | None) -> list[dict]:
    """Blocks that compression must not touch; those that overlap or touch are one, under the first one's label. Texts come to the task a hundred
    at a time, not ten thousand."""
    merged: list[dict] = []
    for start, end, label in _spans(lexicon.PROTECTED_BLOCKS, text or ""):
        if merged and start <= merged[-1]["end"]:
            merged[-1]["end"] = max(end, merged[-1]["end"])
        else:
            merged.append({"label": label, "start": start, "end": end})
    return merged


def protected_ratio(text: Column) -> Column:
    size = F.aggregate(protected_blocks(text), F.lit(0), lambda s, b: s + b["end"] - b["start"])
    return F.coalesce(F.try_divide(size, F.length(text)), F.lit(0.0))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("original", T.StringType())])


_DIGIT = re.compile(r"\d")


@lru_cache(4)
def _has_digit(text: str) -> bool:
    """Remembered, as a text is asked for many kinds in a row."""
    return _DIGIT.search(text) is not None


@lru_cache(4)
def _longest(text: str) -> int:
    return max(map(len, text.split()), default=0)


def _may_hold(text: str, kind: str) -> bool:
    """Whether a text has the characters that every span of a kind has."""
    needs = spans.NEEDS.get(kind)
    if needs is not None and not any(x in text for x in needs) or kind in spans.NUMBERED and not _has_digit(text):
        return False
    if kind in spans.UNNUMBERED and not _has_digit(text) and not any(x in text for x in spans.UNNUMBERED[kind]):
        return False
    if kind in spans.COLONS and spans.COLONS[kind][0] not in text and text.count(":") < spans.COLONS[kind][1]:
        return False
    return kind not in spans.LONG or _longest(text) >= spans.LONG[kind]


_TAKEN = tuple((kind, re.compile(pattern, flags)) for kind, pattern, flags in spans.PROTECTED)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("originals", T.ArrayType(_SPAN)), T.StructField("mark", T.StringType())]))
def protect(texts: pd.Series) -> pd.DataFrame:
    """The text with a placeholder for each protected span, kind after kind, the spans by number, and the mark that placeholders begin with:
    PROTECTED_, or where a text holds that in any case, with so many Q before the line that it does not."""
    def of(text: str | None) -> tuple[str | None, list[dict], str]:
        originals: list[dict] = []
        mark, held = "PROTECTED_", (text or "").upper()
        while mark in held:
            mark = mark.replace("_", "Q_")

        def replace(kind: str):
            def by(m: re.Match) -> str:
                originals.append({"kind": kind, "original": m[0]})
                return f"{mark}{len(originals)}"

            return by

        for kind, pattern in _TAKEN:
            if text and _may_hold(text, kind):
                text = pattern.sub(replace(kind), text)
        return text, originals, mark

    return pd.DataFrame([of(x) for x in texts], columns=["text", "originals", "mark"])


def _put_back(text: str, whole: list[str], originals: list[str], mark: str) -> str:
    """A text with spans for placeholders as replacing them from the last number to the first gives it (10 before 1); whole are the spans with what
    is within them put back. In one pass, but where a placeholder may gain digits from what is put back behind it."""
    if mark not in text:
        return text
    numbered, n = re.escape(mark) + "([0-9]+)", len(originals)
    begun = re.escape(mark) + "[0-9]*"
    if re.search(f"{begun}{re.escape(mark)}", text) or any(re.search(f"{begun}$|{begun}{re.escape(mark)}", x) for x in originals if mark in x):
        for i in range(n, 0, -1):
            text = text.replace(f"{mark}{i}", originals[i - 1])
        return text

    def by(m: re.Match) -> str:
        digits = m[1]
        for k in range(min(len(digits), len(str(n))), 0, -1):
            if digits[0] != "0" and int(digits[:k]) <= n:
                return whole[int(digits[:k]) - 1] + digits[k:]
        return m[0]

    return re.sub(numbered, by, text)


def _whole(originals: list[str], mark: str) -> list[str]:
    """Each span in full, with the earlier ones that are within it."""
    whole: list[str] = []
    for x in originals:
        whole.append(_put_back(x, whole, originals[: len(whole)], mark) if mark in x else x)
    return whole


@F.pandas_udf(T.StringType())
def _reinjected(texts: pd.Series, originals: pd.Series, marks: pd.Series) -> pd.Series:
    of = lambda t, o, m: None if t is None or o is None else _put_back(t, _whole(list(o), m), list(o), m)
    return pd.Series([of(*x) for x in zip(texts, originals, marks)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _missing(texts: pd.Series, originals: pd.Series, marks: pd.Series) -> pd.Series:
    def of(text: str | None, spans, mark: str) -> list[int] | None:
        if spans is None:
            return None
        lost, at, held = [], 0, {}
        for i, x in enumerate(_whole(list(spans), mark) if text is not None else (), 1):
            if x not in held:
                # spans of a kind come in order: the search goes on from the last one found
                found = text.find(x, at)
                found = text.find(x) if found < 0 else found
                held[x], at = found >= 0, max(found, 0)
            if not held[x]:
                lost.append(i)
        return lost

    return pd.Series([of(*x) for x in zip(texts, originals, marks)], dtype=object)


def reinject(text: Column, originals: Column, mark: Column | None = None) -> Column:
    """Placeholders back to what they stand for, from the last to the first: number 10 before 1, and spans within spans."""
    return _reinjected(text, originals["original"], F.lit("PROTECTED_") if mark is None else mark)


def missing(text: Column, originals: Column, mark: Column | None = None) -> Column:
    """The numbers of spans that a text lacks, each in full with what is protected within it."""
    return _missing(text, originals["original"], F.lit("PROTECTED_") if mark is None else mark)


def compressed_messages(messages: DataFrame, text: Column, tokens, least: float = 0.90) -> DataFrame:
    """messages (conv_id, turn, role, text) with what is sent: a user's message compressed where that leaves under ``least`` of its tokens,
    everything else as it is (``fallback`` where compression was tried in vain)."""
    tried = (F.col("role") == "user") & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.length("text") >= 30)
    good = tokens(text) < least * tokens(F.col("text"))
    return messages.select(
        "conv_id", "turn", "role", F.when(tried & good, text).otherwise(F.col("text")).alias("sent"), F.coalesce(tried & ~good, F.lit(False)).alias("fallback"),
        F.when(tried, F.size(words(F.col("text")))).otherwise(0).alias("original_words"), F.when(tried, F.size(words(F.when(good, text).otherwise(F.col("text"))))).otherwise(0).alias("sent_words"),
    )


def critical_missing(original: Column, compressed: Column) -> Column:
    """Labels of addresses, code and data of more than five characters that a compressed text lacks."""
    none = F.array().cast("array<string>")

    def of(label: str, pattern: str) -> Column:
        grouped = f"({pattern})" if not pattern.startswith("(?s)") else f"(?s)({pattern[4:]})"
        found = lambda t: F.when(~F.contains(t, F.lit(lexicon.CRITICAL_HOLD[label])), none).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit(grouped), F.lit(1))))
        return F.transform(F.filter(F.array_except(found(original), found(compressed)), lambda x: F.length(x) > 5), lambda x: F.lit(label))

    return F.concat(*[of(label, p) for label, p in lexicon.CRITICAL])


# --- tables


def markdown_rows(text: Column) -> Column:
    """The rows of a Markdown table after its header and separator: cells without edges and blanks, as many as the header has."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    def of(lines: Column) -> Column:
        width = F.size(cells(F.get(lines, 0)))
        rows = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: ~x.rlike(r"^\s*\|?[\s:|-]+\|?\s*$"))
        return F.transform(rows, lambda x: F.slice(cells(x), F.lit(1), width))

    return let(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|"))), of)


def similar_pairs(docs: DataFrame, percent: int = 85, k: int = 3) -> DataFrame:
    """Pairs (a, b) of documents (doc_id, text) whose sets of k-word shingles agree by percent of their union at least, of equal
    sets only the least doc_id. Exact, by prefix filtering."""
    sets = docs.select(F.col("doc_id").alias("node"), tx.hashed_shingles(F.col("text"), k).alias("s"))
    sets = written(sets.select("node", "s", set_key(F.col("s")).alias("key")), "shingle-sets")
    return set_pairs(sets, percent).select("a", "b", "jaccard")


#: Fixed value: shingles are counted by their last 16 bits.
_BITS = 16


def _rarest_first(sets: DataFrame) -> Column:
    """A set s with its members renamed, one to one, so that they sort by how many of all members of sets share their last bits: those of a
    frequent member are shared by more, so that it comes late in every set."""
    last = lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1))
    counted = sets.select(F.explode("s").alias("x")).groupBy(last(F.col("x")).cast("int").alias("last")).agg(F.count("*").alias("n")).collect()
    count = dict(counted)
    # a fixed number of counts, whatever the input
    rank = [0] * (1 << _BITS)
    for r, i in enumerate(sorted(range(1 << _BITS), key=lambda i: (count.get(i, 0), i))):
        rank[i] = r - (1 << _BITS - 1)
    ranks = F.split(F.lit(",".join(map(str, rank))), ",").cast("array<int>")
    name = lambda x: F.shiftleft(F.get(ranks, last(x).cast("int")).cast("long"), 64 - _BITS).bitwiseOR(F.shiftrightunsigned(x, _BITS))
    return F.sort_array(F.transform("s", name))


def set_key(s: Column) -> Column:
    """128 bits that tell sets (sorted arrays) apart."""
    return F.struct(F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("g"))


def parities(sets: DataFrame) -> DataFrame:
    """node, size and ``bits`` of sets (node, s): of each set how many members fall on each bit of a string of two to four bits a member, as even or odd."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 100) for k in range(0, whole.num_rows, 100)):
                members, n = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy()
                bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
                edges = np.concatenate([[0], np.cumsum(bits)])
                on = np.repeat(edges[:-1], n) + (members & np.repeat(bits - 1, n))
                odd = np.packbits((np.bincount(on, minlength=edges[-1]) & 1).astype(bool))
                found = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edges // 8).astype(np.int32)), pa.py_buffer(odd)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), found], names=["node", "size", "bits"])

    return sets.select("node", "s").mapInArrow(run, T.StructType([sets.schema["node"], T.StructField("size", T.IntegerType()), T.StructField("bits", T.BinaryType())]))


def _odd_bits(a: bytes, b: bytes) -> int:
    """How many bits two parities differ in, the longer one folded: members in which the sets differ, or fewer."""
    if len(a) < len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a), int.from_bytes(b), 4 * len(a)
    while bits >= 8 * len(b):
        x, bits = (x >> bits) ^ (x & ((1 << bits) - 1)), bits // 2
    return (x ^ y).bit_count()


@F.pandas_udf(T.IntegerType())
def _differ(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_odd_bits(x, y) for x, y in zip(a, b)], dtype="int32")


#: Rows of a broadcast table of nodes at most.
_FEW = 1_000_000


def _only(sets: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """sets with (left_semi) or without (left_anti) those of nodes, a table; sets are exchanged only where nodes are many."""
    return sets.join(F.broadcast(nodes) if nodes.count() <= _FEW else nodes, "node", how)


def set_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of sets (node, s: sorted; their key, if known) that agree by percent of their union at least, with how many members they share (``n``), the size
    of their union and their ``jaccard``. Of equal sets only the first node is in pairs. sets should be a table, as it is read several times.

    Whole sets meet last and few: what shares a rare member is a pair of nodes; parities, some twentieth of a set's bytes, rule out pairs that
    differ too much, which loses none; only sets of a pair that is left are exchanged.
    """
    # of each set the rarest members, one of which a pair must share
    first = F.slice(_rarest_first(sets), F.lit(1), (F.size("s") - F.ceil(F.size("s") * percent / F.lit(100)) + 1).cast("int"))
    keyed = sets.select("key" if "key" in sets.columns else set_key(F.col("s")).alias("key"), "node")
    same = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = written(keyed.join(same, "key").filter("node > first").select("node"), "equal-sets")
    firsts = _only(sets, copies, "left_anti")
    prefix = firsts.select("node", F.size("s").alias("size"), F.posexplode(first).alias("before", "shingle")).select("shingle", "node", "size", (F.col("size") - F.col("before")).alias("left"))
    a, b = (prefix.select("shingle", F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("left").alias(f"left_{x}")) for x in "ab")
    # the first member that a pair shares has what they share before it in neither
    enough = F.least("left_a", "left_b") * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))
    near = a.join(b, "shingle").filter((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()
    even = parities(sets)
    for x in "ab":
        near = near.join(even.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    likely = _differ("bits_a", "bits_b") * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    near = written(near.filter(likely).select("a", "b").distinct(), "near-sets")
    nodes = written(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "near-nodes")
    met = _only(sets.select("node", "s"), nodes, "left_semi")
    both = near.join(met.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(met.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("sum"))
    return both.filter(f"100 * n >= {percent} * (sum - n)").select("a", "b", "n", (F.col("sum") - F.col("n")).alias("union"), F.round(F.col("n") / (F.col("sum") - F.col("n")), 6).alias("jaccard"))


def minhash(found: Column, n: int = 64) -> Column:
    """The least of each of n hashes of a set's members."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_min(F.transform(found, lambda x: F.xxhash64(x, i))))


def minhash_likeness(a: Column, b: Column) -> Column:
    """The share of places at which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


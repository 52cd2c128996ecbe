"""Compression of prompts by profile: protection, phases, validation and quality, and when to fall back on the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..storage import written
from . import chunks as ch
from . import clusters as cl
from . import language as la
from . import text as tx
from .measures import let

_PHASE = {"structural": tx.structural, "lexical": tx.lexical, "logical": tx.logical, "temporal": tx.temporal}


def without_equal_blocks(text: Column, separator: str = "\n\n") -> Column:
    """The text without blocks that are equal, but for white space, to an earlier one."""
    def of(x: Column) -> Column:
        return F.filter(x["blocks"], lambda b, i: F.array_position(x["keys"], F.get(x["keys"], i)) == i + 1)

    blocks = F.split(text, separator, -1)
    return F.array_join(let(let(blocks, lambda b: F.struct(b.alias("blocks"), F.transform(b, tx.block_hash).alias("keys"))), of), separator)


def validation(output: Column, originals: Column, mark: Column, lost: Column | None = None) -> Column:
    """Errors of an output: spans that it lacks (by number, where known), placeholders that are left in it."""
    lost = la.missing(output, originals, mark) if lost is None else lost
    left = F.array_distinct(F.regexp_extract_all(output, F.concat(mark, F.lit(r"\d+")), F.lit(0)))
    told = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(name), F.array_join(x.cast("array<string>"), ",")))
    return F.array_compact(F.array(told("spans missing: ", lost), told("placeholders left: ", left)))


def quality(original: Column, compressed: Column, least: float = spans.LEAST_SIMILARITY, most: float = spans.MOST_TOKENS) -> Column:
    """similarity of the two texts' hashed words, the ratio of their tokens at four characters each, kinds of critical content that is lost, and the errors.
    Without a text on either side there is no ratio, and that is an error; an original without a token has ratio 1."""
    tokens = lambda x: F.floor(F.length(x) / 4)
    none = (F.coalesce(F.length(original), F.lit(0)) == 0) | (F.coalesce(F.length(compressed), F.lit(0)) == 0)
    ratio = F.when(none, 0.0).when(tokens(original) == 0, 1.0).otherwise(tokens(compressed) / F.greatest(tokens(original), F.lit(1)))
    same = let(F.struct(ch.hashed(original).alias("a"), ch.hashed(compressed).alias("b")), lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 1.0).otherwise(ch.likeness(x["a"], x["b"])))

    def of(x: Column) -> Column:
        errors = F.array_compact(F.array(
            F.when(x["similarity"] < least, F.lit("similarity")), F.when(none | (x["ratio"] > most), F.lit("token ratio")), F.when(F.size(x["lost"]) > 0, F.concat(F.lit("critical content: "), F.array_join(x["lost"], ","))),
        ))
        return F.struct(F.round(x["similarity"], 4).alias("similarity"), F.round(x["ratio"], 3).alias("token_ratio"), x["lost"].alias("critical_missing"), errors.alias("errors"))

    return let(F.struct(same.alias("similarity"), ratio.alias("ratio"), la.critical_missing(original, compressed).alias("lost")), of)


def compiled(docs: DataFrame, profile: str = "balanced") -> DataFrame:
    """docs (doc_id, t) with ``compressed``, how many spans were protected, errors of validation and (from aggressive on) of quality, and whether to
    ``fall_back`` on the original, which any error asks for.

    In order: spans become placeholders; cues of negation are marked, double ones said outright from aggressive on; the profile's phases; then marks
    go and spans come back. Blocks are compared with each other, by their shingles, in texts of over 200 characters; blocks
    with a placeholder stay.
    """
    p = docs.select("doc_id", "t", la.protect(F.col("t")).alias("p"))
    text, strong = F.col("p.text"), profile in spans.CHUNK_LIKENESS
    phases = spans.PHASES[profile]
    if "semantic_chunk" in phases:
        text = ch.semantic(text, spans.CHUNK_LIKENESS[profile])["text"]
    if strong:
        text = la.consolidate_negations(text, F.col("p.mark"))
    text = la.mark_negated(text)
    if "exact_dedup" in phases:
        text = without_equal_blocks(text)
    p = p.withColumn("now", text)
    if "near_dedup" in phases:
        p = written(p, "protected")  # read twice, worked out once
        p = _without_near_blocks(p)
    text = F.col("now")
    for name in phases:
        text = _PHASE[name](text) if name in _PHASE else text
    p = written(p.withColumn("now", text), "rewritten")  # Python's helpers take columns of a table, not long expressions
    p = p.withColumn("compressed", la.reinject(la.unmark_negated(F.col("now")), F.col("p.originals"), F.col("p.mark")))
    p = p.withColumn("gone", la.missing(F.col("compressed"), F.col("p.originals"), F.col("p.mark")))
    checked = p.withColumn("validation", validation(F.col("compressed"), F.col("p.originals"), F.col("p.mark"), F.col("gone")))
    none = F.array().cast("array<string>")
    judged = quality(F.col("t"), F.col("compressed"), spans.LEAST_SIMILARITY_INDUSTRIAL if profile == "industrial" else spans.LEAST_SIMILARITY)["errors"] if strong else none
    done = checked.withColumn("quality", F.coalesce(judged, none)).withColumn("validation", F.coalesce("validation", none))
    return done.select(
        "doc_id", "t", "compressed", F.size("p.originals").alias("spans"), F.size("gone").alias("lost"),
        "validation", "quality", (F.size("validation") + F.size("quality") > 0).alias("fall_back"),
    )


def _without_near_blocks(p: DataFrame) -> DataFrame:
    """p with ``now`` without near-duplicate blocks. Texts are told apart by a hash of theirs and of their doc_id: equal rows share what is found."""
    key = F.xxhash64("doc_id", "now")
    many = (F.length("now") > spans.NEAR_LENGTH) & (F.size(F.split("now", "\n\n", -1)) >= 5)
    texts = p.filter(many).select(key.alias("doc_id"), F.replace("now", F.col("p.mark"), F.lit("PROTECTED_")).alias("text"), F.col("p.mark").alias("mark")).dropDuplicates(["doc_id"])
    found = cl.deduplicated_blocks(texts.select("doc_id", "text"), "\n\n").filter("removed > 0").join(texts.select("doc_id", "mark"), "doc_id")
    found = found.select(F.col("doc_id").alias("key"), F.replace("text", F.lit("PROTECTED_"), F.col("mark")).alias("shorter"))
    return p.withColumn("key", key).join(found, "key", "left").withColumn("now", F.coalesce("shorter", "now")).drop("key", "shorter")

"""Text detection and rewriting, as chains of built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def chain(text: Column, steps) -> Column:
    for pattern, short in steps:
        text = F.regexp_replace(text, pattern, short)
    return text


def in_stretches(text: Column, steps) -> Column:
    """chain(text, steps) for steps that match no punctuation mark: a match lies between two marks, so that only the stretches in which some step
    finds something, told by one pattern, go through all steps."""
    any_step = rules.any_of([p for p, _ in steps])
    return F.array_join(F.transform(F.split(text, r"(?<=[.,;:!?])", -1), lambda x: F.when(x.rlike(any_step), chain(x, steps)).otherwise(x)), "")


def _steps(table) -> list[tuple[str, str]]:
    return [(rules.pattern(p), s) for p, s in table]


def phrases(text: Column, table) -> Column:
    return in_stretches(text, _steps(table))


def structural(text: Column) -> Column:
    """No rules, no space after headings but one, at most one blank line, no trailing blanks."""
    return F.trim(chain(text, [(r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^(#{1,6})\s+", "$1 "), (r"\n{3,}", "\n\n"), (r"(?m)[ \t]+$", "")]))


def logical(text: Column, lang: str = "en") -> Column:
    return phrases(text, rules.LOGICAL_EN if lang == "en" else rules.LOGICAL_FR)


def temporal(text: Column, lang: str = "en") -> Column:
    return phrases(text, rules.TEMPORAL_EN if lang == "en" else rules.TEMPORAL_FR)


def shorten(text: Column) -> Column:
    return phrases(text, rules.PHRASES_EN)


def without_fluff(text: Column) -> Column:
    return phrases(text, rules.FLUFF_EN)


_COURTESY = [(f"(?iU){rules.EDGE}{p}" + ("" if p.endswith("+") or p.endswith(")?") else rules.EDGE), s) for p, s in rules.POLITE_EN]


def without_courtesy(text: Column) -> Column:
    return in_stretches(text, _COURTESY)


def lexical(text: Column) -> Column:
    """Phrases, fluff and courtesy, then the spaces they leave."""
    done = in_stretches(text, _steps(rules.PHRASES_EN) + _steps(rules.FLUFF_EN) + _COURTESY)
    return F.trim(chain(done, [(" +", " "), (r"\s+([.,;:!?])", "$1"), (r"\s{2,}", " ")]))


def light_clean(text: Column) -> Column:
    done = chain(text, [(r"!{2,}", "!"), (r"\?{2,}", "?"), (rules.pattern(rules.FILLERS), "")])
    return F.trim(F.regexp_replace(done, r"\s+", " "))


def html_text(html: Column) -> Column:
    """Styles, scripts and tags out, white space to single spaces."""
    return F.trim(chain(html, [(r"(?is)<style[^>]*>.*?</style>", ""), (r"(?is)<script[^>]*>.*?</script>", ""), (r"<[^>]+>", " "), (r"\s+", " ")]))


def sniff_format(text: Column) -> Column:
    t = F.trim(text)
    first, second = F.get(F.split(t, "\n"), 0), F.get(F.split(t, "\n"), 1)
    return (
        F.when(F.length(t) == 0, "txt").when(t.startswith("<html"), "html").when(t.startswith("<?xml") | t.rlike(r"^<\w+[^>]*>"), "xml")
        .when((t.startswith("{") | t.startswith("[")) & F.try_parse_json(t).isNotNull(), "json").when(t.startswith("---") & F.contains(F.substring(t, 1, 200), F.lit(":")), "yaml")
        .when((F.size(F.split(t, "\n")) > 2) & first.rlike(r"^[-\w\s]+$") & F.coalesce(second.rlike(r"^[-|=]+\s*$"), F.lit(False)), "csv").otherwise("txt")
    )


def is_noise(line: Column) -> Column:
    t = F.lower(F.trim(line))
    legal = r"copyright|©|all\s+rights?\s+reserved|confidential|disclaimer|proprietary|classified"
    few = (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) < 3) & ~t.rlike("[0-9]")
    return (t == "") | t.rlike(r"^[0-9]{1,4}$") | t.rlike(r"^page\s+[0-9]+|^p\.\s*[0-9]+|^-\s*[0-9]+\s*-$") | t.rlike(legal) | few


def without_noise(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_noise(x)), "\n")


def modality(sentence: Column) -> Column:
    out = None
    for name, words in rules.MODALITY_EN:
        hit = sentence.rlike(rules.pattern(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("MUST")


def negated(sentence: Column, kind: Column) -> Column:
    matched = sentence.rlike(rules.pattern("|".join(w for _, w in rules.MODALITY_EN)))
    return kind.isin("FORBIDDEN", "MUST_NOT", "SHOULD_NOT") | (matched & sentence.rlike(rules.pattern(rules.NEGATED)))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def constraints(docs: DataFrame) -> DataFrame:
    """doc_id and t to one row per sentence with its modality and whether it is negated."""
    s = docs.select("doc_id", F.posexplode(sentences(F.col("t"))).alias("position", "sentence"))
    s = s.withColumn("modality", modality(F.col("sentence")))
    return s.withColumn("negated", negated(F.col("sentence"), F.col("modality")))


def negation_cues(text: Column) -> Column:
    count = lambda words: F.regexp_count(text, F.lit(rules.pattern(words)))
    return count(rules.NEGATION_CUES_EN) + count(rules.NEGATION_CONTRACTED_EN)


def block_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The first of the documents with the same normalised text, and how many there are.

    A count and a least id per hash combine before the shuffle, whatever the size of a group of copies.
    """
    return docs.groupBy(block_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts, lower-cased and with white space collapsed: size, first and last member."""
    key = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    by = docs.groupBy(key.alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return by.filter("n > 1")


def repeated_lines(docs: DataFrame, least: int = 50) -> DataFrame:
    """Lines of at least ``least`` characters that occur more than once in a document."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= least)
    return lines.groupBy("doc_id", F.sha2("line", 256).alias("hash")).agg(F.count("*").alias("n")).filter("n > 1")


def shingles(text: Column, k: int = 3) -> Column:
    """The distinct k-word shingles of a text; its whole word sequence where it has fewer."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    of = lambda a: F.when(F.size(a) < k, F.array(F.array_join(a, " "))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.array_join(F.slice(a, i + 1, k), " "))))
    return F.element_at(F.transform(F.array(w), of), 1)


def hashed_shingles(text: Column, k: int = 3, *marks: Column) -> Column:
    """64-bit hashes of the shingles of a text and of marks, sorted; those of an empty text for a null one."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    every = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(k)], *marks))
    of = lambda a: F.when(F.size(a) < k, F.array(F.xxhash64(a, *marks))).otherwise(F.array_distinct(every(a)))
    return F.sort_array(F.element_at(F.transform(F.array(w), of), 1))


def key_sentences(docs: DataFrame, k: int = 2) -> DataFrame:
    """The k sentences of each document (doc_id, t) that score highest: long words twice, numbers three times, capitals once, and two more at either end."""
    s = docs.select("doc_id", sentences(F.col("t")).alias("s")).select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("position", "sentence"))
    count = lambda p: F.regexp_count("sentence", F.lit(p))
    edge = F.when((F.col("position") == 0) | (F.col("position") == F.col("n") - 1), 2).otherwise(0)
    s = s.withColumn("score", 2 * count(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{7,}") + 3 * count("[0-9]+") + count(r"(?<![A-Za-z0-9_])[A-Z][a-z]+") + edge)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "position")
    return s.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) | (F.col("n") <= k + 1)).select("doc_id", "position", "score", "sentence")


def table_compaction(headers: Column, rows: Column) -> Column:
    """A table as its header line with a row count, or with its only row."""
    head = F.array_join(headers, " | ")
    return F.when(F.size(rows) == 1, F.concat(head, F.lit(" | "), F.array_join(F.get(rows, 0), " | "))).otherwise(F.concat(head, F.lit(" ("), F.size(rows).cast("string"), F.lit(" rows)")))


def rate_cap(ratio: Column) -> Column:
    return F.when(ratio >= 0.30, 0.15).when(ratio >= 0.15, 0.25).when(ratio >= 0.05, 0.40).otherwise(1.0)

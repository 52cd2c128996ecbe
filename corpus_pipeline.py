"""The corpus pipeline: quality rules, language ID, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Rows are told apart by 64-bit hashes of what a verdict depends on, which no table of numbered rows need keep.

Defined cases: each row has its own verdict, whether its doc_id is null, repeated or shared by other texts; of each group of
near-duplicates one row stays, that with the least doc_id (null after all others; any of those that repeat it); texts
without words are in no group and all stay there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlake.llm.common import documents, materialize
from promptlake.llm.jaccard_join import jaccard_join
from promptlake.llm.language_id import UNKNOWN, fit, held_out, identify
from promptlake.llm.packing import pack
from promptlake.llm.quality_rules import quality_rules

#: A document goes when the best of its languages is less likely than this, or it has no language.
LEAST_SCORE = 0.3


KEY, ROW = "corpus_pipeline_key", "corpus_pipeline_row"
#: Any character but ASCII white space.
WORDED = r"[^\x20\x09-\x0D]"


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with KEY, a 64-bit hash of the columns named and of which of them are null: rows that agree in these share it."""
    named = [F.col(c) for c in columns]
    return docs.withColumn(KEY, F.xxhash64(*named, *[c.isNull() for c in named]))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that quality_rules keeps. Null, empty and short texts go; each row is judged by its own text, also where rows repeat
    or share a doc_id; an empty table stays empty; all columns of docs are kept, whatever their names."""
    rows = keyed(docs, "text", "lang", "source")
    kept = quality_rules(rows.withColumn("doc_id", F.col(KEY))).filter("kept").select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(kept, KEY, "left_semi").drop(KEY)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is known with LEAST_SCORE at least. Null texts and texts without letters go, as do all rows where no
    language was learned; repeated rows share their verdict; an empty table stays empty; all columns of docs are kept, whatever their names."""
    # the whole row stands for its doc_id, so that no names can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    found = identify(whole, fit(docs.filter(~held_out())))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc_id.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): that with the least doc_id, null after all others, any of those
    that repeat it. Null texts and texts without words are in no group and stay; an empty table stays empty; all columns of
    docs are kept, whatever their names."""
    rows = keyed(docs, "doc_id", "text")
    groups = jaccard_join(rows.select(F.col(KEY).alias("doc_id"), "text"), n=5, percent=80).select(F.col("doc_id").alias(KEY), "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY))
    kept = rows.select(KEY, "doc_id").distinct().join(groups, KEY).groupBy("component_id").agg(least.alias("least")).select(F.col(f"least.{KEY}").alias(KEY))
    # of rows that share a key one stays, but for those that are in no group
    one = F.when(F.coalesce("text", F.lit("")).rlike(WORDED), 0).otherwise(F.monotonically_increasing_id())
    return rows.join(kept, KEY, "left_semi").withColumn(ROW, one).dropDuplicates([KEY, ROW]).drop(KEY, ROW)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' token pieces in sequences of 1024 at most. Null and empty texts are packed as the end token alone, repeated rows
    as often as they occur; an empty table stays empty; other columns are not read."""
    return pack(docs)


STAGES = [
    ("quality rules", keep_good_quality),
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("best-fit packing", pack_sequences),
]

#: SQL can express none of the fitted models; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

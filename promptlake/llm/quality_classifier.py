"""Quality classifier: ordinal regression on graded ratings.

A cumulative-link (proportional odds) model: one weight per hashed text feature, shared by all grades, gives a document
a latent value; ordered thresholds cut it into grades: P(grade > k) = 1 / (1 + exp(threshold_k - latent)). It is learned
by proximal gradient steps on a bounded sample of rated rows: ``sample`` documents of each grade, those whose ids hash
lowest, which is the documented bound. Every document is then scored from
its whole text: the expected grade, and the tail probability of reaching the selected grade.

Defined cases: null and blank texts have no features and are scored by the thresholds alone, but never kept; documents rated more than
once teach with their lowest grade; ratings with nulls teach nothing; without ratings of two grades every score is null
and every text with a word is kept; repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .features import word_features

BITS = 18


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray | None:
        """P(grade > k) for every grade but the last, or None without a model."""
        if len(self.grades) < 2:
            return None
        x = word_features(text, BITS) if text else np.zeros(0, np.int64)
        return sigmoid(self.weights[x].sum() - self.thresholds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _slopes(latent: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the mean of -ln P(grade), by each row's latent value and by each threshold."""
    n, last, rows = len(grade), len(thresholds), np.arange(len(grade))
    above = sigmoid(latent[:, None] - thresholds)
    upper = np.where(grade > 0, above[rows, np.maximum(grade - 1, 0)], 1.0)
    lower = np.where(grade < last, above[rows, np.minimum(grade, last - 1)], 0.0)
    p = np.maximum(upper - lower, 1e-9)
    by_upper, by_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_threshold = [by_upper[grade == k + 1].sum() - by_lower[grade == k].sum() for k in range(last)]
    return (by_lower - by_upper) / n, np.array(by_threshold) / n


def _descend(texts: list[np.ndarray], grade: np.ndarray, size: int, thresholds: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds after accelerated proximal gradient steps on the mean loss with an l1 penalty."""
    lengths = np.array([len(x) for x in texts])
    flat, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), lengths)
    latent = lambda w: np.bincount(row, weights=w[flat], minlength=len(texts))
    back = lambda s: np.bincount(flat, weights=s[row], minlength=size)
    direction, scale = np.ones(size), 1.0
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        direction = back(latent(direction))
        scale = max(float(np.linalg.norm(direction)), 1e-9)
        direction = direction / scale
    rate = 2 * len(texts) / scale
    w, ahead, pace = np.zeros(size), np.zeros(size), 1.0
    for _ in range(steps):
        by_row, by_threshold = _slopes(latent(ahead), grade, thresholds)
        new = ahead - rate * back(by_row)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        thresholds = np.sort(thresholds - 2 * by_threshold)
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        w, ahead, pace = new, new + (pace - 1) / faster * (new - w), faster
    return w, thresholds


def train(rows: pd.DataFrame, l1: float = 4e-3, least: int = 10, most: float = 0.12, steps: int = 600) -> OrdinalModel:
    """rows: grade and text. Features found in under ``least`` texts, or over a share ``most`` of them without telling grades
    apart, are left out; an l1 penalty picks among the others, and those it picks are fitted once more with a slight one."""
    grades = sorted(int(g) for g in rows["grade"].unique())
    model = OrdinalModel(grades, np.zeros(1 << BITS), np.arange(len(grades) - 1, dtype=float) - (len(grades) - 2) / 2)
    if len(grades) < 2:
        return model
    texts = [word_features(t, BITS) for t in rows["text"]]
    grade = np.array([grades.index(g) for g in rows["grade"]])
    found = np.bincount(np.concatenate(texts), minlength=1 << BITS)
    rows_of, share = np.bincount(grade), found / len(texts)
    by_grade = np.stack([np.bincount(np.concatenate([x for x, g in zip(texts, grade, strict=True) if g == k]), minlength=1 << BITS) for k in range(len(grades))])
    explained = (rows_of[:, None] * (by_grade / rows_of[:, None] - share) ** 2).sum(0) / np.maximum(len(texts) * share * (1 - share), 0.5)
    keep = (found >= min(least, max(1, len(texts) // 20))) & ((share <= most) | (explained >= 0.2))
    for penalty in (l1, l1 / 15):
        if not keep.any():
            break
        number = np.cumsum(keep) - 1
        w, thresholds = _descend([number[x[keep[x]]] for x in texts], grade, int(keep.sum()), model.thresholds, penalty, steps)
        model.weights[:] = 0
        model.weights[np.flatnonzero(keep)] = w
        model.thresholds = thresholds
        keep = model.weights != 0
    return model


def fit(docs: DataFrame, graded: DataFrame, sample: int = 4000) -> OrdinalModel:
    """docs: doc_id and text; graded: doc_id and grade. At most ``sample`` documents of each grade, those whose ids hash
    lowest, are looked up (a broadcast of that many ids) and reach the driver."""
    graded = graded.filter(F.col("grade").isNotNull())
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    if not counts:
        return OrdinalModel([], np.zeros(1 << BITS), np.zeros(0))
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, 3 * sample / n))])
    low = graded.withColumn("order", F.xxhash64("doc_id")).filter(F.pmod("order", F.lit(1 << 20)) <= share[F.col("grade")] * (1 << 20))
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("grade").orderBy("order", "doc_id"))).filter(F.col("rank") <= sample)
    chosen = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ranked.select("doc_id", "grade", "rank")), "doc_id")
    rows = chosen.select("rank", "grade", "text").toPandas()
    return train(rows.sort_values(["rank", "grade"]).reset_index(drop=True)) if len(rows) else OrdinalModel([], np.zeros(1 << BITS), np.zeros(0))


def score(docs: DataFrame, model: OrdinalModel, select: int, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of ``select`` or better) and kept of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    last = sum(g < select for g in model.grades) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                tails = shared.value.tails(text)
                words = bool(text and text.strip())
                if tails is None:
                    out.append((None, None, words))
                    continue
                tail = 1.0 if last < 0 else float(tails[last]) if last < len(tails) else 0.0
                out.append((shared.value.grades[0] + float(tails @ np.diff(shared.value.grades)), tail, words and tail >= least))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def graded_labels(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 of low quality, 1 toxic, 2 neither."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    return score(docs, fit(docs, graded_labels(labels), sample), select=2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

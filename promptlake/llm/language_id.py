"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every labelled training row. The weights are learned with follow-the-regularised-leader
(FTRL-proximal, elastic-net penalty) on a bounded sample: ``sample`` distinct texts of each language, those that hash
lowest, which is the documented bound; a third of them is kept back to fit the temperature that calibrates the
scores. Every document is then predicted from its whole text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language teach nothing
but are predicted; repeated rows are predicted alike; ties between languages go to the first in alphabetical order;
with no labelled row at all every document is ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents
from .features import char_ngrams

BITS = 14
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        grams = char_ngrams(text, BITS) if text else None
        if grams is None:
            return None
        values = (1 + np.log(grams[1])) * self.idf[grams[0]]
        return grams[0], values / np.sqrt(values @ values)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = self.vector(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax((self.weights[:, x[0]] @ x[1] + self.weights[:, -1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal with elastic net for a table of weights; the last column is the bias."""

    def __init__(self, rows: int, columns: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((rows, columns)), np.zeros((rows, columns))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        n = self.n[:, at]
        sigma = (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha
        self.z[:, at] += gradient - sigma * weights
        self.n[:, at] = n + gradient**2


def train(sample: pd.DataFrame, idf: np.ndarray, epochs: int = 3) -> LanguageModel:
    """sample: lang and text in the order of training; every third row of a language calibrates."""
    model = LanguageModel(sorted(sample["lang"].unique()), idf, np.zeros((0, 0)), 1.0)
    k = len(model.languages)
    held = sample.groupby("lang").cumcount() % 3 == 2
    vectors = [(model.languages.index(lang), x, h) for lang, text, h in zip(sample["lang"], sample["text"], held, strict=True) if (x := model.vector(text)) is not None]
    learner = Ftrl(k, len(idf) + 1)
    for _ in range(epochs):
        for y, (slots, values), h in vectors:
            if h:
                continue
            at, x = np.append(slots, len(idf)), np.append(values, 1.0)
            w = learner.weights(at)
            p = softmax(w @ x)
            p[y] -= 1
            learner.update(at, np.outer(p, x), w)
    model.weights = learner.weights()
    logits = [(y, model.weights[:, s] @ v + model.weights[:, -1]) for y, (s, v), h in vectors if h]
    if logits:
        y, z = np.array([a for a, _ in logits]), np.array([b for _, b in logits])
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    return model


def held_out() -> Column:
    """Whether a row is held out; one without doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            grams = char_ngrams(text, BITS)
            if grams is not None:
                counts[grams[0]] += 1
                rows += 1
    if rows:
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(counts[slots], rows))], names=["slot", "n"])


def fit(labelled: DataFrame, sample: int = 600) -> LanguageModel:
    """labelled: text and lang. The sample that reaches the driver has at most ``sample`` texts of each language, all different."""
    labelled = labelled.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = labelled.select("text").mapInArrow(_document_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    rows = int(found.loc[found["slot"] < 0, "n"].sum())
    found = found[found["slot"] >= 0]
    df[found["slot"].to_numpy(int)] = found["n"].to_numpy()
    idf = np.log((1 + rows) / (1 + df)) + 1
    labelled = labelled.withColumn("order", F.xxhash64("text"))
    by_language = {r["lang"]: r["count"] for r in labelled.select("lang", "order").distinct().groupBy("lang").count().collect()}
    if not by_language:
        return LanguageModel([], idf, np.zeros((0, len(idf) + 1)), 1.0)
    # a first cut by the hash, loose by a factor of three, so that few rows reach the ranking
    share = F.create_map(*[F.lit(x) for lang, n in by_language.items() for x in (lang, min(1.0, 3 * sample / n))])
    low = labelled.filter(F.pmod("order", F.lit(1 << 20)) <= share[F.col("lang")] * (1 << 20))
    low = low.groupBy("lang", "order").agg(F.first("text").alias("text"))  # copies are one, combined before they are exchanged
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("rank") <= sample)
    return train(ranked.toPandas().sort_values(["rank", "lang"]).reset_index(drop=True), idf)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id (of any type), lang_pred and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(predict, schema)


def language_id(docs: DataFrame, sample: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows of docs that are not held out."""
    model = fit(docs.filter(~held_out()), sample)
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))

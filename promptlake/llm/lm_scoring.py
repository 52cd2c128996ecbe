"""Stupid-backoff language-model scores.

Counts of the n-grams of 1 to ``order`` words come from all rows of the corpus. With N words in all and a context u of up to
order - 1 words,

    ln S(w | u) = ln c(u w) - ln c(u)               where u w is kept,
                  ln(backoff) + ln S(w | u')        where it is not, u' being u without its first word,
    ln S(w)     = ln c(w) - ln N;

the first words of a document have the contexts that there are, without a penalty. All counts are kept unless ``least`` is
greater than 1; then what is seen less often is pruned, and a word that is pruned counts as seen once. Words are what white space
parts, in lower case; n-grams are known by 64-bit hashes of their context and 30 bits of their last word.

All counts kept (``least`` = 1, the query): tasks read the texts once and deal out their n-grams by the hash of the context, as
arrays of a few thousand at a time, so that an n-gram costs twelve bytes of exchange. Where a bucket arrives, the counts of its
n-grams and contexts are taken and each document's n-grams meet them. A bucket answers each slice of documents that it has n-grams of
in one row, with arrays of places in the slice and of values, and a slice's answers are summed together: there is no row for each
document and bucket, a slice gets no more values than it has n-grams, and a document leaves as one row. The first words need no tables of their own: the factors c(w1) / N, c(w1 w2) / c(w1), ... of a document's start leave c(w1 ... wk) / N, and
c(w1 ... wk) for k = order - 1 is the count of a context. Documents of fewer words ask for shorter n-grams, whose counts are
summed by batches of documents before they are dealt out.

Hot contexts: a bounded sample of documents tells which contexts and n-grams may hold more than a quarter of a bucket, ``HOT`` at
most, which decides only where their counts are taken: not in buckets, but summed by task, document and key in a table of their
own, whose counts (``HOT`` rows at most) go to the tasks. The n-grams of a hot context are dealt out by context and word.

Pruned counts: tables of counts keyed by words' hashes, joined to the exploded n-grams in equi-joins that adaptive execution
splits where one key is large.

Defined cases: null and blank texts have no words, score null and perplexity null; rows that share a doc_id are one
document, and each shows its score; rows without doc_id are counted and have no score; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import broadcast_if_small, documents, materialize

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: What stands for the last word: none follows (it counts for the context), or a document asks for the context's count.
END, ASK = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
#: Set in the last word's hash where the context's count is taken elsewhere.
ELSEWHERE = np.uint32(1 << 30)
#: N-grams that a bucket is meant for, documents dealt out at a time, documents of the sample, hot keys at most.
BUCKET, SLICE, SAMPLE, HOT = 2_000_000, 2_000, 5_000, 100_000


def _hashes(text: str | None) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def ngrams(docs: DataFrame, order: int) -> DataFrame:
    """(doc_id, x1, ..., x<order>, n): each document's distinct n-grams as hashes of words; what comes before the first is 0."""
    names = [f"x{j}" for j in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                at, grams, n = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    w = _hashes(text)
                    if len(w):
                        padded = np.concatenate((np.zeros(order - 1, np.uint64), w))
                        found, counts = np.unique(np.lib.stride_tricks.sliding_window_view(padded, order), axis=0, return_counts=True)
                        at.append(np.full(len(found), row))
                        grams.append(found)
                        n.append(counts)
                if at:
                    columns = np.concatenate(grams).view(np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.concatenate(at))), *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(np.concatenate(n).astype(np.int32))],
                        names=["doc_id", *names, "n"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} long' for x in names)}, n int")


def _values(rows: DataFrame, tables: dict[int, DataFrame], names: list[str], size: int, total: int, least: int, backoff: float) -> DataFrame:
    """rows (names) with the value of their last ``size`` words: ln S of the last word after the others."""
    keys = names[len(names) - size :]
    found = rows.join(tables[size].withColumnRenamed("c", "_c"), keys)
    if size == 1:
        return found.select(*names, (F.log(F.when(F.col("_c") >= least, F.col("_c")).otherwise(F.lit(1)).cast("double")) - F.log(F.lit(float(total)))).alias("value"))
    context = tables[size - 1].select(*[F.col(k).alias(to) for k, to in zip(names[len(names) - size + 1 :], keys[:-1])], F.col("c").alias("_of_context"))
    kept = found.filter(F.col("_c") >= least).join(context, keys[:-1]).select(*names, (F.log("_c") - F.log("_of_context")).alias("value"))
    shorter = _values(found.filter(F.col("_c") < least).select(*names), tables, names, size - 1, total, least, backoff)
    return kept.unionByName(shorter.withColumn("value", F.log(F.lit(backoff)) + F.col("value")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    rows = max(0, len(words) - size + 1)
    found = np.full(rows, size, np.uint64)
    for k in range(size):
        found = _mix(found * _C + words[k : k + rows])
    return found


def _entries(texts: list[str | None], order: int) -> tuple[np.ndarray, ...]:
    """doc (-1: none), context, last word and n of what the texts count and ask for; an ask's n is how many words it speaks for."""
    hashes = [_hashes(x) for x in texts]
    sizes = np.array([len(x) for x in hashes], np.int64)
    words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    starts, at = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    docs, contexts, lasts, ns = [], [], [], []

    def add(doc: np.ndarray, context: np.ndarray, last, n) -> None:
        docs.append(doc)
        contexts.append(context)
        lasts.append(np.broadcast_to(np.asarray(last, np.uint32), len(doc)))
        ns.append(np.broadcast_to(np.asarray(n, np.int32), len(doc)))

    k = order - 1
    if k:
        windows = _windows(words, k)
        inside = np.arange(k, len(words))
        inside = inside[at[inside] == at[inside - k]] if len(inside) else inside
        add(at[inside], windows[inside - k], (words[inside] & np.uint64(ELSEWHERE - np.uint32(1))).astype(np.uint32), 1)
        whole = np.flatnonzero(sizes >= k)
        add(whole, windows[starts[whole] + sizes[whole] - k], END, 1)
        add(whole, windows[starts[whole]], ASK, sizes[whole])
    else:
        keys = _windows(words, 1)
        add(np.full(len(keys), -1), keys, END, 1)
        add(at, keys, ASK, 1)
    for size in range(1, k):  # for documents of fewer words than a context has
        windows = _windows(words, size)
        same = at[: len(windows)] == at[size - 1 :][: len(windows)]
        keys, n = np.unique(windows[same], return_counts=True)
        add(np.full(len(keys), -1), keys, END, n)
        short = np.flatnonzero(sizes == size)
        add(short, windows[starts[short]], ASK, size)
    return np.concatenate(docs), np.concatenate(contexts), np.concatenate(lasts), np.concatenate(ns)


def _key(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    return _mix(context * _B + last.astype(np.uint64))


def _hot_keys(docs: DataFrame, order: int, rows: int, share: float) -> np.ndarray:
    """Contexts and n-grams that hold at least ``share`` of a sample of about SAMPLE documents, HOT at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, context, last, n = _entries(batch.column(0).to_pylist(), order)
            counted = last != ASK
            keys = np.concatenate((context[counted], _key(context, last)[last < ELSEWHERE]))
            keys, at = np.unique(keys, return_inverse=True)
            sums = np.bincount(at, np.concatenate((n[counted], n[last < ELSEWHERE]))).astype(np.int64)
            often = sums > 1
            total = pa.array([int(n[counted].sum())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(sums[often])], names=["key", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), total], names=["key", "n"])

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / max(1, rows)) * (1 << 20))))
    sums = materialize(chosen.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "sampled-ngrams")
    total = sums.filter("key is null").agg(F.sum("n")).first()[0] or 0
    often = sums.filter(F.col("key").isNotNull() & (F.col("n") > F.lit(share * total))).orderBy(F.desc("n"), "key").limit(HOT)
    return np.sort(np.array([r["key"] for r in often.collect()], np.int64).view(np.uint64))


def _of_hot_keys(docs: DataFrame, order: int, hot: np.ndarray, kind: str) -> DataFrame:
    """doc_id, part, words and asks: what documents have of hot contexts and n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, context, last, n = _entries(batch.column(1).to_pylist(), order)
            whole, word = _key(context, last), last < ELSEWHERE
            keys, docs_, weights, ns, words, asks = [], [], [], [], [], []
            of_hot, ask = np.isin(context, hot), last == ASK
            for key, here, sign in ((context, of_hot, -1), (whole, word & of_hot & np.isin(whole, hot), 1)):
                keys.append(key[here])
                docs_.append(doc[here])
                weights.append(np.where(ask, 1, np.where(last == END, 0, sign * n))[here])
                ns.append(np.where(ask, 0, n)[here])
                words.append(np.where(ask, n, 0)[here])
                asks.append(ask[here])
            doc, key = np.concatenate(docs_), np.concatenate(keys)
            if len(doc):
                both, at = np.unique(np.column_stack((doc.astype(np.int64), key.view(np.int64))), axis=0, return_inverse=True)
                sums = [pa.array(np.bincount(at.ravel(), np.concatenate(x)).astype(np.int64)) for x in (weights, ns, words, asks)]
                ids = batch.column(0).take(pa.array(both[:, 0], pa.int64(), mask=both[:, 0] < 0))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.ascontiguousarray(both[:, 1])), *sums], names=["doc_id", "key", "weight", "n", "words", "asks"])

    rows = materialize(docs.mapInArrow(run, f"doc_id {kind}, key long, weight long, n long, words long, asks long"), "hot-ngrams")
    counts = rows.groupBy("key").agg(F.sum("n").alias("c"))  # a row for each of the hot keys at most
    value = F.sum(F.when(F.col("weight") == 0, 0.0).otherwise(F.col("weight") * F.log(F.col("c").cast("double"))))
    return rows.join(broadcast_if_small(counts, len(hot), HOT), "key").groupBy("doc_id").agg(value.alias("part"), F.sum("words").alias("words"), F.sum("asks").alias("asks"))


def _dealt(docs: DataFrame, order: int, buckets: int, hot: np.ndarray, kind: str) -> DataFrame:
    """bucket, slice, ids, places, sizes, contexts, lasts, ns: the entries of a slice of documents that fall into a bucket, by places in the
    slice (-1: none) with their numbers of entries. ids: the slice's documents, in one of its rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = 0
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                doc, context, last, n = _entries(batch.column(1).to_pylist(), order)
                bucket = context % np.uint64(buckets)
                if len(hot):
                    word, key, of_hot = last < ELSEWHERE, _key(context, last), np.isin(context, hot)
                    stays = ~of_hot | (word & ~np.isin(key, hot))
                    # without a hot context's count, its n-grams only need meet each other
                    bucket, last = np.where(of_hot, key % np.uint64(buckets), bucket), np.where(word & of_hot, last | ELSEWHERE, last)
                    doc, context, last, n, bucket = (x[stays] for x in (doc, context, last, n, bucket))
                if not len(doc):
                    continue
                order_ = np.lexsort((doc, bucket))
                doc, context, last, n, bucket = (x[order_] for x in (doc, context, last, n, bucket))
                runs = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])])
                first = np.flatnonzero(np.r_[True, bucket[runs][1:] != bucket[runs][:-1]])
                of = lambda edges, values: pa.ListArray.from_arrays(pa.array(np.append(edges, len(values)), pa.int32()), values)
                sizes = np.diff(np.append(runs, len(doc))).astype(np.int32)
                at = runs[first]
                number = (batch.column(2)[0].as_py() << 32) + slices
                slices += 1
                ids = pa.ListArray.from_arrays(pa.array([0, *[batch.num_rows] * len(first)], pa.int32()), batch.column(0))
                arrays = [ids, of(first, pa.array(doc[runs].astype(np.int16))), of(first, pa.array(sizes)), of(at, pa.array(context.view(np.int64))), of(at, pa.array(last.view(np.int32))), of(at, pa.array(n))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array(np.full(len(first), number)), *arrays], names=["bucket", "slice", "ids", "places", "sizes", "contexts", "lasts", "ns"])

    parted = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    return parted.mapInArrow(run, f"bucket long, slice long, ids array<{kind}>, places array<short>, sizes array<int>, contexts array<long>, lasts array<int>, ns array<int>")


def _of_buckets(dealt: DataFrame, kind: str) -> DataFrame:
    """slice, ids, places, parts, asking and words of each slice in each bucket: its n-grams' values, by the counts that the bucket holds,
    summed for each place, and the numbers of words of the places that ask for a count."""

    def run(table: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten()
        places, sizes, n = flat("places").to_numpy(), flat("sizes").to_numpy(), flat("ns").to_numpy()
        context, last = flat("contexts").to_numpy().view(np.uint64), flat("lasts").to_numpy().view(np.uint32)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        _, at = np.unique(context, return_inverse=True)
        ask, word = last == ASK, last < ASK
        of_context = np.log(np.maximum(np.bincount(at, np.where(ask, 0, n)), 1))
        _, whole = np.unique((at[word].astype(np.uint64) << np.uint64(32)) | last[word], return_inverse=True)
        values = np.zeros(len(doc))
        values[word] = n[word] * np.log(np.bincount(whole, n[word]))[whole]
        known = word & (last < ELSEWHERE)
        values[known] -= n[known] * of_context[at[known]]
        values[ask] = of_context[at[ask]]
        part = np.bincount(doc, values, len(sizes))
        edges = np.append(0, np.cumsum(table.column("places").combine_chunks().value_lengths().to_numpy()))
        asked = np.searchsorted(edges, doc[ask], side="right") - 1  # the row of each ask
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
        asks = np.append(0, np.cumsum(np.bincount(asked, minlength=len(edges) - 1)))
        arrays = {"places": lists(edges, places), "parts": lists(edges, part), "asking": lists(asks, places[doc[ask]]), "words": lists(asks, n[ask])}
        return pa.table({"slice": table.column("slice"), "ids": table.column("ids"), **arrays})

    return dealt.groupBy("bucket").applyInArrow(run, f"slice long, ids array<{kind}>, places array<short>, parts array<double>, asking array<short>, words array<int>")


def _of_slices(answers: DataFrame, kind: str) -> DataFrame:
    """doc_id, part, words and asks of each document that a slice's answers tell of."""

    def run(table: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten()
        ids = flat("ids")
        places, asking = flat("places").to_numpy(), flat("asking").to_numpy()
        known = places >= 0
        told = np.flatnonzero(np.bincount(places[known], minlength=len(ids)))
        part = np.bincount(places[known], flat("parts").to_numpy()[known], len(ids))
        words, asks = np.bincount(asking, flat("words").to_numpy(), len(ids)).astype(np.int64), np.bincount(asking, minlength=len(ids)).astype(np.int64)
        return pa.table({"doc_id": ids.take(pa.array(told)), "part": part[told], "words": words[told], "asks": asks[told]})

    return answers.groupBy("slice").applyInArrow(run, f"doc_id {kind}, part double, words long, asks long")


def score(docs: DataFrame, least: int = 1, backoff: float = 0.4, order: int = 3) -> DataFrame:
    """doc_id, n_words, log_score and perplexity of every row of docs, with counts of up to ``order`` words from all of docs."""
    docs = docs.select("doc_id", "text")
    sums = _sums_of_all_counts(docs, order) if least <= 1 else _sums_of_kept_counts(docs, least, backoff, order)
    out = docs.select("doc_id").join(sums, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.round("log_score", 6).alias("log_score"), F.round(F.exp(-F.col("log_score") / F.col("n_words")), 6).alias("perplexity"))


def _sums_of_all_counts(docs: DataFrame, order: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    buckets = 8 + chars // (6 * BUCKET)
    hot = _hot_keys(docs, order, rows, 0.25 / buckets)
    parts = _of_slices(_of_buckets(_dealt(docs, order, buckets, hot, kind), kind), kind)
    if len(hot):
        parts = parts.unionByName(_of_hot_keys(docs, order, hot, kind))
    sums = materialize(parts.groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in ("part", "words", "asks")]), "document-sums")
    total = sums.agg(F.sum("words")).first()[0] or 1
    return sums.select("doc_id", F.col("words").alias("n_words"), (F.col("part") - F.col("asks") * F.log(F.lit(float(total)))).alias("log_score"))


def _sums_of_kept_counts(docs: DataFrame, least: int, backoff: float, order: int) -> DataFrame:
    names = [f"x{j}" for j in range(1, order + 1)]
    rows = ngrams(docs, order)
    # with those that begin before the document: each word ends one row's n-gram, so that shorter ones are counted from these
    whole = materialize(rows.groupBy(*names).agg(F.sum("n").alias("c")), "ngram-counts")
    total = whole.agg(F.sum("c")).first()[0] or 1
    tables = {order: whole.filter(F.col(names[0]) != 0)}
    for size in range(order - 1, 0, -1):
        keys = names[order - size :]
        tables[size] = materialize(whole.filter(F.col(keys[0]) != 0).groupBy(*keys).agg(F.sum("c").alias("c")), f"counts-of-{size}")
    values = None
    for size in range(order, 0, -1):
        of_size = whole.filter(F.col(names[order - size]) != 0)
        if size < order:
            of_size = of_size.filter(F.col(names[order - size - 1]) == 0)
        found = _values(of_size.select(*names), tables, names, size, total, least, backoff)
        values = found if values is None else values.unionByName(found)
    return rows.join(values, names).groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("value")).alias("log_score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))

"""Alignment of two tokenizers over the same texts: groups between common token ends, links within groups, counts of linked ids.

Python tasks tokenize only; from the arrays of ids and token ends on, all is Spark's higher-order functions. No token of either
vocabulary goes over a blank between two other characters, so a text is a sequence of units between those, and both tokenizers end a
token where a unit ends. A task hands on texts in portions: each text as numbers of units, and the portion's different units
once, with their tokens, so that groups and links are worked out once for each unit of a portion. Where a common end stands among a
side's ends is found by sorting both arrays together: a unit of n tokens costs n log n. A task holds one portion, and no
units of earlier ones; the files of the table of portions have few rows each, as Spark reads all rows of a file at once up to some thousands.
Only id pairs are exchanged, counted before the exchange; their number is bounded by the vocabularies and not by the corpus.

Defined cases: a null or empty text, or one that either tokenizer does not give back byte by byte, has no tokens: zeros and an empty
groups_sha256; strings of special tokens are plain text; each of repeated rows has its own result and counts as a document; a
very long text is a portion of its own, with arrays as long as its units and links; ties for the highest count are all best; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_at, documents, ends_up_to, let, materialize
from .packing import byte_level_vocabulary, default_vocabulary, ordinary_encoder

UNIT = "struct<a_ids:array<int>,a_ends:array<int>,b_ids:array<int>,b_ends:array<int>>"
#: Characters of the texts in a portion, unless one has more; portions in a file; units given to a tokenizer at a time; rows read at a time.
PORTION, PORTIONS, CALL, SLICE = 500_000, 4, 500, 500
#: Blanks between characters that are none.
BLANK = re.compile(r"(?<=\S) (?=\S)")
PAIR = 1 << 32


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def _sides(vocabulary: str, pieces: str):
    """For each of the two: texts to ids, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    known = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        known.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    entries = byte_level_vocabulary(vocabulary)
    shown = [b""] * (max(entries.values()) + 1)
    for content, i in entries.items():
        shown[i] = content
    encode = ordinary_encoder(vocabulary)
    return (lambda texts: [encode(" " + x) for x in texts], shown), (lambda texts: model.encode(texts, num_threads=1), known)


def _lists(rows: list) -> pa.ListArray:
    edges = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([*map(len, rows)], out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, edges[-1])))


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _tokens(texts: list[str], sides) -> list[list[tuple[np.ndarray, np.ndarray]] | None]:
    """For each text the ids and the ends in bytes of each side's tokens, or None where a tokenizer does not give it back."""
    found: list[list | None] = []
    for text, *own in zip(texts, *(encode(texts) for encode, _ in sides)):
        target, sided = (" " + text).encode(), []
        for ids, (_, known) in zip(own, sides):
            shown = [known[i] for i in ids]
            if b"".join(shown) != target:
                sided = None
                break
            sided.append((np.array(ids, np.int32), np.cumsum([*map(len, shown)], dtype=np.int32)))
        found.append(sided)
    return found


def laid_out(units: list[str], sides) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Each side's ids and token ends over all units laid end to end, where each unit ends, and which units a tokenizer does not give back,
    which have no length here. Units without blanks at their ends are tokenized together, a blank between."""
    sizes = np.fromiter((len(x.encode()) + 1 for x in units), np.int64, len(units))
    bad, parts = np.zeros(len(units), bool), []
    for start in range(0, len(units), CALL):
        some = units[start : start + CALL]
        joined = None
        if not any(x[0].isspace() or x[-1].isspace() for x in some):
            joined = _tokens([" ".join(some)], sides)[0]
        if joined is not None:
            parts.append((sizes[start : start + CALL].sum(), joined))
        else:
            for k, own in enumerate(_tokens(some, sides), start):
                bad[k] = own is None
                if own is not None:
                    parts.append((sizes[k], own))
    begins = np.cumsum([0, *(size for size, _ in parts)])
    none = np.empty(0, np.int32)
    laid = [(np.concatenate([none, *(own[k][0] for _, own in parts)]), np.concatenate([none, *(own[k][1] + np.int32(at) for at, (_, own) in zip(begins, parts))])) for k in range(2)]
    return laid, np.cumsum(np.where(bad, 0, sizes)), bad


def portions(docs: DataFrame, vocabulary: str, pieces: str, portion: int = PORTION) -> DataFrame:
    """Rows of ``docs``, each with row, doc_id, numbers of tokens and ``units`` (places in the row's ``units``), and ``units``: ids and byte
    offsets of token ends of both tokenizers. A text without tokens has no units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(vocabulary, pieces)

        def packed(rows: list, known: dict[str, int]) -> pa.RecordBatch:
            laid, ends, bad = laid_out([*known], sides)
            places = [x[2][:0] if bad[x[2]].any() else x[2] for x in rows]
            edges = [np.concatenate([[0], np.searchsorted(side[1], ends, "right")]) for side in laid]
            columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], id_type)]
            columns += [pa.array(np.fromiter((n[x].sum() for x in places), np.int64, len(rows))) for n in map(np.diff, edges)]
            texts = pa.StructArray.from_arrays([*columns, _lists(places)], names=["row", "doc_id", "n_a", "n_b", "units"])
            begins, lists = np.concatenate([[0], ends]), []
            for (ids, tops), edge in zip(laid, edges):
                for x in (ids, tops - np.repeat(begins[:-1], np.diff(edge))):
                    lists.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x.astype(np.int32))))
            table = pa.StructArray.from_arrays(lists, names=["a_ids", "a_ends", "b_ids", "b_ends"])
            return pa.RecordBatch.from_arrays([_one_list(texts), _one_list(table)], names=["docs", "units"])

        rows, known, size = [], {}, 0
        for whole in batches:
            id_type = whole.column(1).type
            for batch in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)):
                for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    text = text or ""
                    if rows and size + len(text) > portion:
                        yield packed(rows, known)
                        rows, known, size = [], {}, 0
                    size += len(text)
                    places = [known.setdefault(unit, len(known)) for unit in BLANK.split(text)] if text else ()
                    rows.append((row, doc_id, np.array(places, np.int32)))
        if rows:
            yield packed(rows, known)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, f"docs array<struct<row:long,doc_id:{kind},n_a:long,n_b:long,units:array<int>>>, units array<{UNIT}>")


def aligned_unit(unit: Column) -> Column:
    """groups (as text), n_groups and links of a unit: an id of A and one of B for each pair of tokens that share a group."""
    def of(common: Column) -> Column:
        sides = [cut_at(unit[f"{x}_ids"], ends_up_to(unit[f"{x}_ends"], common)) for x in "ab"]
        return F.zip_with(*sides, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def told(groups: Column) -> Column:
        shown = F.transform(groups, lambda g: F.concat(F.array_join(g["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(g["b"].cast("array<string>"), ",")))
        linked = F.transform(groups, lambda g: F.flatten(F.transform(g["a"], lambda a: F.transform(g["b"], lambda b: a.cast("long") * PAIR + b))))
        return F.struct(F.array_join(shown, ";").alias("groups"), F.size(groups).cast("long").alias("n_groups"), F.flatten(linked).alias("links"))

    # where the two agree on all ends, each token has a group
    pairs = lambda body: F.zip_with(unit["a_ids"], unit["b_ids"], body)
    shown = F.array_join(pairs(lambda a, b: F.concat_ws("|", a.cast("string"), b.cast("string"))), ";")
    alike = F.struct(shown.alias("groups"), F.size(unit["a_ids"]).cast("long").alias("n_groups"), pairs(lambda a, b: a.cast("long") * PAIR + b).alias("links"))
    return F.when(unit["a_ends"] == unit["b_ends"], alike).otherwise(let(let(F.array_intersect(unit["a_ends"], unit["b_ends"]), of), told))


def aligned(found: DataFrame) -> DataFrame:
    """Portions with ``docs`` (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, units) and, of their units, the linked ids ``of`` A and ``to`` B."""
    def of(units: Column) -> Column:
        total = lambda d, value: F.aggregate(d["units"], F.lit(0).cast("long"), lambda n, i: n + value(F.get(units, i)))

        def doc(d: Column) -> Column:
            text = F.array_join(F.transform(d["units"], lambda i: F.get(units, i)["groups"]), ";")
            sums = [total(d, lambda u: u["n_groups"]).alias("n_groups"), total(d, lambda u: F.size(u["links"]).cast("long")).alias("n_links")]
            hashed = F.when(F.size(d["units"]) > 0, F.sha2(text, 256)).otherwise("").alias("groups_sha256")
            return F.struct(*[d[c].alias(c) for c in ("row", "doc_id", "n_a", "n_b")], *sums, hashed, d["units"].alias("units"))

        halves = [F.transform(units, lambda u: F.transform(u["links"], lambda x: F.shiftright(x, 32).cast("int"))), F.transform(units, lambda u: F.transform(u["links"], lambda x: (x % PAIR).cast("int")))]
        return F.struct(F.transform("docs", doc).alias("docs"), halves[0].alias("of"), halves[1].alias("to"))

    return found.select(let(F.transform("units", aligned_unit), of).alias("x")).select("x.*")


def _with_links(kept: DataFrame, value) -> DataFrame:
    """value(a portion's links by unit), exploded."""
    links = F.zip_with("of", "to", lambda x, y: F.zip_with(x, y, lambda a, b: a.cast("long") * PAIR + b))
    return kept.select(F.explode(let(links, value)).alias("x"))


def align(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, portion: int = PORTION) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    kept = materialize(aligned(portions(docs, vocabulary or default_vocabulary(), pieces or default_pieces(), portion)), "links", PORTIONS)
    of = lambda links, places: F.flatten(F.transform(places, lambda i: F.get(links, i)))
    held = _with_links(kept, lambda links: F.flatten(F.transform("docs", lambda d: F.array_distinct(of(links, F.array_distinct(d["units"]))))))
    counts = held.groupBy(F.col("x").alias("pair")).agg(F.count("*").alias("documents"))
    counts = materialize(counts.withColumn("of", F.shiftright("pair", 32)), "link-counts")
    highest = counts.groupBy("of").agg(F.max("documents").alias("highest"))  # at most a row for each id of the vocabulary
    rated = counts.join(broadcast_if_small(highest, highest.count(), 200_000), "of").select("pair", "documents", (F.col("documents") == F.col("highest")).cast("long").alias("best"))
    rated = materialize(rated, "rated-links")
    linked = _with_links(kept, lambda links: F.transform("docs", lambda d: F.struct(d["row"].alias("row"), of(links, d["units"]).alias("links"))))
    sums = linked.select("x.row", F.explode("x.links").alias("pair")).join(broadcast_if_small(rated, rated.count(), 2_000_000), "pair")
    sums = sums.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("documents").alias("count_sum"))
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = kept.select(F.explode(F.transform("docs", lambda d: F.struct(*[d[c].alias(c) for c in columns]))).alias("x")).select("x.*").join(sums, "row", "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))

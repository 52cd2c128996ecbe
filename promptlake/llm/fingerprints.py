"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A paragraph is a sentence of a line, whatever the line's length. The set of a text's paragraph digests is
sketched in cells; each digest enters one cell in each of three sub-tables, where a cell keeps the count, the exclusive
or of its digests, and that of their check values. Sets too large for one table are split by digest into a power of two
of tables, so that the work grows with the text's length. Everything is column expressions.

The fingerprint is these cells as text, and equal for equal sets. Fingerprints of two versions subtract cell by cell, which leaves only
what differs; peeling cells that hold a single digest recovers the differing digests. Where peeling stops short, or the two
have different numbers of tables, both are sketched again with tables twice as wide, and where the widest fail, with other
hashes. The likeness of two versions is their digests' Jaccard similarity, from the number of recovered differences.

Defined cases: null text counts as empty; two texts without paragraphs are alike (1.0); rows that repeat a doc_id follow
one another in the order of their texts' hashes; a table of one row has itself as next; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_SET, cut_at, documents, ends_up_to, let

#: Width of a fingerprint's sub-tables, how many digests of one version a table is meant for, and of both versions in retries.
WIDTH, LOAD, LOAD_BOTH = 8, 24, 48
#: Widths of a sub-table that are tried in turn, with the seeds of their hashes.
RETRIES = ((32, 0), (64, 0), (256, 0), (256, 1), (512, 2))
ROUNDS = 12


def digests(text: Column) -> Column:
    """The sorted distinct 64-bit digests of the text's paragraphs that are not blank."""
    trimmed = F.transform(F.split(text, "\n|(?<=[.!?]) "), lambda x: F.btrim(x, F.lit(SPACE_SET)))
    return F.sort_array(F.array_distinct(F.transform(F.filter(trimmed, lambda x: F.length(x) > 0), lambda x: F.xxhash64(x))))


def _slot(digest: Column, table: Column, width: Column, seed: Column) -> Column:
    """The digest's cell in a sub-table: the tables read different bits of the digest."""
    digest = F.when(seed == 0, digest).otherwise(F.xxhash64(digest, seed))
    bits = F.when(table == 0, digest).when(table == 1, F.shiftrightunsigned(digest, 21)).otherwise(F.shiftrightunsigned(digest, 42))
    return F.pmod(bits, width)


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.alias("key"), check.alias("check"))


def _put(cell: Column, digest: Column, n: Column) -> Column:
    return _cell(cell["n"] + n, cell["key"].bitwiseXOR(digest), cell["check"].bitwiseXOR(F.xxhash64(digest)))


def sketch(found: Column, width: Column, seed: Column) -> Column:
    """The cells of the three sub-tables, one after the other."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def sub_table(table: Column) -> Column:
        slots = F.transform(found, lambda x: _slot(x, table, width, seed).cast("int"))
        cell = lambda at, j: F.aggregate(F.filter(found, lambda x, i: F.get(at, i) == j), empty, lambda a, x: _put(a, x, F.lit(1)))
        return let(slots, lambda at: F.transform(F.sequence(F.lit(0), width.cast("int") - 1), lambda j: cell(at, j)))

    return F.flatten(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), sub_table))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def peel(cells: Column, width: Column, seed: Column) -> Column:
    """How many digests the subtracted cells hold, or null where peeling stops before they are empty."""
    def single(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"]) == c["check"])

    def slots(key: Column, n: int) -> Column:
        return F.struct(F.lit(n).alias("n"), key.alias("key"), *[_slot(key, F.lit(t), width, seed).cast("int").alias(f"at_{t}") for t in range(3)])

    def taken(cells: Column, out: Column) -> Column:
        """The cells without the digests of out, whose places are worked out once: a sub-table after the other."""
        def sub_table(t: int) -> Column:
            own = F.slice(cells, F.lit(t) * width + 1, width)
            return F.transform(own, lambda c, j: F.aggregate(F.filter(out, lambda x: x[f"at_{t}"] == j), c, lambda a, x: _put(a, x["key"], -x["n"])))

        return F.concat(*map(sub_table, range(3)))

    def step(state: Column, _: Column) -> Column:
        def with_singles(out: Column) -> Column:
            return F.when(F.size(out) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("more"))).otherwise(
                F.struct(taken(state["cells"], out).alias("cells"), (state["found"] + F.size(out)).alias("found"), F.lit(True).alias("more"))
            )

        def keys(alone: Column, n: int) -> Column:
            return F.transform(F.array_distinct(F.transform(F.filter(alone, lambda c: c["n"] == n), lambda c: c["key"])), lambda key: slots(key, n))

        singles = let(F.filter(state["cells"], single), lambda alone: F.concat(keys(alone, 1), keys(alone, -1)))
        return F.when(state["more"], let(singles, with_singles)).otherwise(state)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("more"))
    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(~left(s), s["found"]))


def _differing(a: Column, b: Column) -> Column:
    """The number of digests in one of two sets only, by sketches of growing width."""
    def attempt(state: Column, x: Column) -> Column:
        width, seed = x["width"], x["seed"]
        tried = peel(subtract(sketch(a, width, seed), sketch(b, width, seed)), width, seed)
        hopeless = F.abs(F.size(a) - F.size(b)) > 3 * width
        return F.when(state.isNotNull() | hopeless, state).otherwise(tried)

    tries = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(s).alias("seed")) for w, s in RETRIES])
    by_sketch = F.aggregate(tries, F.lit(None).cast("int"), attempt)
    # for the case that digests share all cells under each seed
    return F.coalesce(by_sketch, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def _parts(found: Column, tables: Column) -> Column:
    """The digests by table: sorted by their table once, and cut where that changes."""
    keyed = F.sort_array(F.transform(found, lambda x: F.struct(F.pmod(F.shiftrightunsigned(x, 11), tables).cast("int").alias("table"), x.alias("digest"))))
    return let(keyed, lambda k: cut_at(F.transform(k, lambda x: x["digest"]), ends_up_to(F.transform(k, lambda x: x["table"]), F.sequence(F.lit(0), tables - 1))))


def cells(found: Column) -> Column:
    """The cells of a digest array's tables, one after the other."""
    tables = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(found) / F.lit(float(LOAD)))))).cast("int")
    many = F.transform(_parts(found, tables), lambda x: sketch(x, F.lit(WIDTH), F.lit(0)))
    return F.when(F.size(found) <= LOAD, sketch(found, F.lit(WIDTH), F.lit(0))).otherwise(F.flatten(many))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The Jaccard similarity of two digest arrays, from what the difference of their cells peels to, or of wider ones."""
    each = 3 * WIDTH
    peeled = lambda i: peel(subtract(F.slice(cells_a, i * each + 1, F.lit(each)), F.slice(cells_b, i * each + 1, F.lit(each))), F.lit(WIDTH), F.lit(0))
    # a table that does not peel leaves null, and those after it are left out
    by_cells = F.aggregate(F.sequence(F.lit(0), (F.size(cells_a) / each).cast("int") - 1), F.lit(0), lambda s, i: F.when(s.isNotNull(), s + peeled(i)))

    both = F.size(a) + F.size(b)
    tables = F.ceil(both / F.lit(LOAD_BOTH)).cast("int")
    many = F.aggregate(F.zip_with(_parts(a, tables), _parts(b, tables), _differing), F.lit(0), lambda s, x: s + x)
    wider = F.when(tables == 1, _differing(a, b)).otherwise(many)
    differing = F.when((both == 0) | (a == b), F.lit(0)).otherwise(F.coalesce(F.when(F.size(cells_a) == F.size(cells_b), by_cells), wider))
    return let(differing.cast("double"), lambda d: F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d)))


def fingerprint(found: Column, sketched: Column) -> Column:
    """The number of digests, then of each cell the count, digests and check values in hexadecimal; empty cells as nothing."""
    shown = F.transform(sketched, lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(F.concat(F.hex(c["n"].cast("long")), F.lit("."), F.hex(c["key"]), F.lit("."), F.hex(c["check"]))))
    return F.concat(F.size(found).cast("string"), F.lit(":"), F.array_join(shown, ","))


def with_next(docs: DataFrame, columns: list[str], rows_each: int = 2000, most: int = 65_536) -> DataFrame:
    """docs (doc_id, columns), each row with the columns of the next row by doc_id as next_<column>; after the last, the first.

    doc_ids are cut into ranges of about ``rows_each`` rows (at most ``most`` ranges); each range also gets a copy of the
    first row of the range that follows, so one exchange of the rows finds every successor.
    """
    n = docs.count()
    ranges = max(1, min(most, -(-n // rows_each)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))).first()[0] if n else []
    bounds = sorted(set(bounds)) if ranges > 1 else []
    order = F.xxhash64(*columns)
    placed = docs
    if bounds:
        held = F.lit(np.array(bounds, np.int64))  # one literal of `most` numbers at most
        half = lambda lo_hi, _: let(F.floor((lo_hi["lo"] + lo_hi["hi"]) / 2).cast("int"), lambda mid: F.when(
            lo_hi["lo"] >= lo_hi["hi"], lo_hi).when(F.get(held, mid) < F.col("doc_id"), F.struct((mid + 1).alias("lo"), lo_hi["hi"].alias("hi"))).otherwise(F.struct(lo_hi["lo"].alias("lo"), mid.alias("hi"))))
        search = F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), half, lambda x: x["lo"])
        placed = docs.withColumn("range", search)
    else:
        placed = docs.withColumn("range", F.lit(0))
    firsts = placed.groupBy("range").agg(F.min("doc_id").alias("doc_id"))  # at most `most` rows
    by_range = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(by_range), F.max("range").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    copies = docs.join(F.broadcast(firsts.select("doc_id", before.alias("range"))), "doc_id")
    copies = copies.select("doc_id", *columns, "range", F.lit(1).alias("copy"))
    everything = placed.select("doc_id", *columns, "range", F.lit(0).alias("copy")).unionByName(copies)
    in_order = Window.partitionBy("range").orderBy("copy", "doc_id", order)
    return everything.select("*", *[F.lead(c).over(in_order).alias(f"next_{c}") for c in columns]).filter("copy = 0").drop("copy", "range")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's and its edited text's fingerprints, and how alike they and the next document's are."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("found", digests(F.col("text")))
    pairs = with_next(found, ["text", "found"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "found", "next_found", edited.alias("edited"))
    out = pairs.select("doc_id", "n_chars", "found", "next_found", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_found"))
    out = out.withColumns({f"{c}_cells": cells(F.col(f"{c}found")) for c in ("", "edited_", "next_")})
    of = lambda c: (F.col(f"{c}found"), F.col(f"{c}_cells"))
    near = lambda c: likeness(F.col("found"), of(c)[0], F.col("_cells"), of(c)[1])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(*of("")).alias("fingerprint"), fingerprint(*of("edited_")).alias("edited_fingerprint"),
        near("edited_").alias("near_edited"), near("next_").alias("near_next"),
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))

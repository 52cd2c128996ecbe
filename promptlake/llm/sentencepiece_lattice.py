"""SentencePiece encoding and decoding as relational operations on a lattice.

Texts fall into units that no piece crosses (a run of the space mark with the characters after it, or a line break). For each distinct
unit of the corpus, substrings of up to the longest piece are exploded and equi-joined to the piece table; the edges found
are grouped by unit and folded by a higher-order aggregate. Units then go back to their documents by join. Characters without a
piece become bytes.

The fold is Viterbi: edge by edge in the order of their ends, with the best scores of the last ends and what leads to each, the path
of greatest summed score. The piece table of a unigram model gives the library's ids. A BPE model's scores rank merges instead;
their sum has few and common pieces as well, and decodes to the same text, but the library's ids come from merging the best
adjacent pair until none is left, which is the other fold (``unigram=False``).

The piece table, fixed by the model file, is the only thing broadcast.

The folds copy what they have of a unit in each step, which suits words. Units over ``LONG`` characters (text without spaces)
are searched or merged by a small helper inside tasks instead, with a table of ends or a heap, to the same result.

Defined cases: null and empty texts have no ids and decode to the empty text; rows that share a doc_id each get the ids of
their own text; the leftmost of equally good merges is taken first, and of equal Viterbi paths the one with the longer last piece; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, materialize

SPACE_MARK = "▁"
LONG = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id, score, is_byte and hex (its bytes) of every piece of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = []
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i)
            raw = piece[3:5] if sp.is_byte(i) else piece.replace(SPACE_MARK, " ").encode().hex()
            rows.append((piece, i, float(sp.get_score(i)), sp.is_byte(i), raw))
    return spark.createDataFrame(rows, "piece string, id int, score double, is_byte boolean, hex string")


def units(text: Column) -> Column:
    """A text's units in order; the library puts a space mark in front and turns spaces into marks."""
    marked = F.concat(F.lit(SPACE_MARK), F.regexp_replace(text, " ", SPACE_MARK))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(f"(\\n|{SPACE_MARK}*[^{SPACE_MARK}\\n]+|{SPACE_MARK}+)"), F.lit(1)))


def lattice(found: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit, and its edges (end, size, start, id, score) by end and size."""
    size = F.length("unit")
    starts = found.select("unit", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    spans = starts.select("unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start") + 1))).alias("size"))
    table = F.broadcast(pieces.filter("NOT is_byte").select("piece", "id", "score"))
    edges = spans.withColumn("piece", F.substring("unit", F.col("start"), F.col("size"))).join(table, "piece", "left").filter("id IS NOT NULL OR size = 1")
    edge = F.struct((F.col("start") + F.col("size") - 1).alias("end"), "size", "start", "id", "score")
    return edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def merged(edges: Column, length: Column) -> Column:
    """BPE: symbols as (start, size, id), merging the adjacent pair whose joint edge has the greatest score while there is one."""
    first = F.transform(F.filter(edges, lambda e: e["size"] == 1), lambda e: F.struct(e["start"].alias("start"), e["size"].alias("size"), e["id"].alias("id")))

    def best(symbols: Column) -> Column:
        """(-score, position, size, id) of the best merge, or null."""
        def joint(s: Column, i: Column) -> Column:
            after = F.get(symbols, i + 1)
            span = s["size"] + after["size"]
            return F.get(F.filter(edges, lambda e: (e["start"] == s["start"]) & (e["size"] == span)), F.lit(0))

        options = F.transform(symbols, lambda s, i: let(joint(s, i), lambda e: F.when(e.isNotNull(), F.struct((-e["score"]).alias("cost"), i.alias("i"), e["size"].alias("size"), e["id"].alias("id")))))
        return F.array_min(F.filter(options, lambda o: o.isNotNull()))

    def step(state: Column, _: Column) -> Column:
        def apply(b: Column) -> Column:
            joined = F.transform(state["symbols"], lambda s, i: F.when(i == b["i"], F.struct(s["start"].alias("start"), b["size"].alias("size"), b["id"].alias("id"))).otherwise(s))
            rest = F.filter(joined, lambda s, i: i != b["i"] + 1)
            return F.when(b.isNull(), F.struct(state["symbols"].alias("symbols"), F.lit(False).alias("more"))).otherwise(F.struct(rest.alias("symbols"), F.lit(True).alias("more")))

        return F.when(state["more"], let(best(state["symbols"]), apply)).otherwise(state)

    start = F.struct(first.alias("symbols"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), length), start, step, lambda s: s["symbols"])


def viterbi(edges: Column, length: Column, longest: int, unknown: float = -1e4) -> Column:
    """Unigram: symbols of the path of greatest summed score; a character without a piece costs ``unknown``.

    While edges end at ``end``, best, size and id are those of the best path to there; scores are the best ones of the ``longest``
    ends before it, and back has for each of all ends before it the size and id of the last symbol on its best path.
    """
    def step(state: Column, e: Column) -> Column:
        on = e["end"] != state["end"]
        scores = F.when(on, F.concat(state["scores"], F.array(state["best"]))).otherwise(state["scores"])
        scores = let(scores, lambda x: F.when(F.size(x) > longest, F.slice(x, 2, longest)).otherwise(x))

        def better(s: Column) -> Column:
            score = s["score"]
            wins = on | (score >= state["best"])
            back = F.when(on, F.concat(state["back"], F.array(F.struct(state["size"].alias("size"), state["id"].alias("id"))))).otherwise(state["back"])
            return F.struct(
                e["end"].alias("end"), F.when(wins, score).otherwise(state["best"]).alias("best"), F.when(wins, e["size"]).otherwise(state["size"]).alias("size"),
                F.when(wins, e["id"]).otherwise(state["id"]).alias("id"), s["scores"].alias("scores"), back.alias("back"),
            )

        arrived = let(scores, lambda x: F.struct((F.element_at(x, -e["size"]) + F.coalesce(e["score"], F.lit(unknown))).alias("score"), x.alias("scores")))
        return let(arrived, better)

    def trace(back: Column) -> Column:
        def symbol(state: Column, _: Column) -> Column:
            def before(b: Column) -> Column:
                found = F.struct((state["at"] - b["size"] + 1).alias("start"), b["size"].alias("size"), b["id"].alias("id"))
                return F.struct((state["at"] - b["size"]).alias("at"), F.concat(F.array(found), state["path"]).alias("path"))

            return F.when(state["at"] > 0, let(F.get(back, state["at"]), before)).otherwise(state)

        none = F.array().cast("array<struct<start:int,size:int,id:int>>")
        return F.aggregate(F.sequence(F.lit(1), length), F.struct(length.alias("at"), none.alias("path")), symbol, lambda s: s["path"])

    zero = F.struct(
        F.lit(0).alias("end"), F.lit(0.0).alias("best"), F.lit(0).alias("size"), F.lit(None).cast("int").alias("id"),
        F.array().cast("array<double>").alias("scores"), F.array().cast("array<struct<size:int,id:int>>").alias("back"),
    )
    ends = F.aggregate(edges, zero, step, lambda s: F.concat(s["back"], F.array(F.struct(s["size"].alias("size"), s["id"].alias("id")))))
    return let(ends, trace)


def merged_long(unit: str, table: dict[str, tuple[int, float]]) -> list[str]:
    """What ``merged`` finds, as strings, with a heap of candidate merges over a linked list of symbols."""
    symbols, after, before = list(unit), [*range(1, len(unit)), -1], [-1, *range(len(unit) - 1)]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (found := table.get(both := symbols[i] + symbols[after[i]])):
            heapq.heappush(heap, (-found[1], i, both))

    for i in range(len(symbols)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j < 0 or symbols[i] + symbols[j] != both:
            continue
        symbols[i], symbols[j], after[i] = both, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [x for x in symbols if x]


def viterbi_long(unit: str, table: dict[str, tuple[int, float]], longest: int, unknown: float = -1e4) -> list[str]:
    """What ``viterbi`` finds, as strings."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(unit) + 1):
        sizes = range(1, min(longest, end) + 1)
        options = [(best[end - n][0] + (table[unit[end - n : end]][1] if unit[end - n : end] in table else unknown), n) for n in sizes if n == 1 or unit[end - n : end] in table]
        best.append(max(options))
    out, end = [], len(unit)
    while end:
        out.append(unit[end - best[end][1] : end])
        end -= best[end][1]
    return out[::-1]


def encode_units(found: DataFrame, pieces: DataFrame, unigram: bool) -> DataFrame:
    """unit and its ids."""
    longest = pieces.agg(F.max(F.length("piece"))).first()[0]
    bytes_ = {r["hex"].upper(): r["id"] for r in pieces.filter("is_byte").collect()}
    table = F.array(*[F.lit(bytes_.get(f"{b:02X}", 0)) for b in range(256)])
    of_bytes = lambda h: F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.get(table, F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int")))
    ids = lambda s: F.when(s["id"].isNotNull(), F.array(s["id"])).otherwise(of_bytes(F.hex(F.encode(F.substring(F.col("unit"), s["start"], F.lit(1)), "utf-8"))))
    folded = viterbi(F.col("edges"), F.length("unit"), longest) if unigram else merged(F.col("edges"), F.length("unit"))
    symbols = lattice(found.filter(F.length("unit") <= LONG), pieces, longest).select("unit", folded.alias("symbols"))
    short = symbols.select("unit", F.flatten(F.transform("symbols", ids)).alias("ids"))

    # the piece table again, as a dictionary for the helper: as large as the model file
    known = {r["piece"]: (r["id"], r["score"]) for r in pieces.filter("NOT is_byte").collect()}
    shared = found.sparkSession.sparkContext.broadcast((known, bytes_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = shared.value
        for batch in batches:
            out = []
            for unit in batch.column(0).to_pylist():
                parts = viterbi_long(unit, names, longest) if unigram else merged_long(unit, names)
                out.append([i for x in parts for i in ([names[x][0]] if x in names else [raw.get(f"{b:02X}", 0) for b in x.encode()])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["unit", "ids"])

    return short.unionByName(found.filter(F.length("unit") > LONG).mapInArrow(run, "unit string, ids array<int>"))


def encode(docs: DataFrame, model: str | None = None, unigram: bool = True) -> DataFrame:
    """row (a number of the row), doc_id and ids of every row of docs."""
    pieces = piece_table(docs.sparkSession, model or default_model())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    placed = rows.select("row", F.posexplode(units(F.col("text"))).alias("position", "unit"))
    known = materialize(encode_units(placed.select("unit").distinct(), pieces, unigram), "unit-ids")
    by_row = placed.join(known, "unit").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("position", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda x: x["ids"]))
    return rows.select("row", "doc_id").join(by_row, "row", "left").select("row", "doc_id", F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (ids) with the text that the ids stand for. The piece table joins as one row: an array with an entry per id."""
    pieces = piece_table(encoded.sparkSession, model or default_model()).select("id", "hex")
    by_id = pieces.agg(F.map_from_entries(F.collect_list(F.struct("id", "hex"))).alias("known"), F.max("id").alias("last"))
    by_id = by_id.select(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("known", i), F.lit(""))).alias("pieces"))
    text = F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.get("pieces", i)), "")), "utf-8")
    joined = encoded.join(F.broadcast(materialize(by_id, "pieces-by-id")))
    return joined.withColumn("text", F.substring(F.coalesce(text, F.lit("")), 2, 2**31 - 1)).drop("pieces")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the ids, and the digest of the text that they decode to."""
    out = decode(encode(documents(spark, sf_dir)))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))

"""Best-fit packing of token sequences by bin completion.

Documents are tokenized and cut into pieces by Spark tasks. Pieces of equal length are interchangeable, so packing
needs only how many pieces there are of each length: a histogram of at most ``capacity`` rows, whatever the corpus.
``complete_bins`` solves that histogram by branch and bound; its answer is a list of bin patterns with
multiplicities, which becomes slots in rank order for each length, and Spark hands the slots to the ranked pieces.

Defined cases: null text packs as the end token alone; an added token of the vocabulary that a text holds is that token; repeated rows are packed as often as they occur; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, documents, materialize

CAPACITY, END = 1024, 2
#: The pre-tokenizer's pattern of byte-level BPE vocabularies of this kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 50_000
LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_level_vocabulary(vocabulary: str) -> dict[bytes, int]:
    """The bytes of each entry of a byte-level BPE file, without added tokens, and its id."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}


def added_tokens(vocabulary: str) -> dict[str, int]:
    with open(vocabulary, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file).get("added_tokens", ())}


@lru_cache(4)
def ordinary_encoder(vocabulary: str, added: bool = False):
    """text to ids as the tokenizers library gives them for a byte-level BPE file, run by tiktoken at several times the speed;
    ``added``: an added token that a text holds is that token, else plain text.
    Texts with a run of white space that is too long for tiktoken's pattern go to the library itself."""
    import tiktoken

    special = added_tokens(vocabulary)
    encoder = tiktoken.Encoding("pieces", pat_str=WORDS, mergeable_ranks=byte_level_vocabulary(vocabulary), special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) > LONG_RUN and LONG_SPACE.search(text):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(vocabulary)
            library.encode_special_tokens = not added
            return library.encode(text, add_special_tokens=False).ids
        if added and any(x in text for x in special):
            return encoder.encode(text, allowed_special="all")
        return encoder.encode_ordinary(text)

    return encode


def _encoder(vocabulary: str):
    return ordinary_encoder(vocabulary, added=True)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; of a document that is cut, the first may be shorter."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end], "<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    at.append(row)
                    out.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: bin contents with how many bins hold them."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                fit = capacity // size
                whole, rest = divmod(left, fit)
                for copies, bins in ((fit, whole), (rest, 1)):
                    if copies and bins:
                        open_bins[capacity - copies * size][(size,) * copies] += bins
                break
            content, bins = next(iter(open_bins[room].items()))
            used = min(bins, left)
            open_bins[room][content] -= used
            if not open_bins[room][content]:
                del open_bins[room][content]
                if not open_bins[room]:
                    del open_bins[room]
            open_bins[room - size][(*content, size)] += used
            left -= used
    return [(content, n) for by in open_bins.values() for content, n in by.items()]


def reachable(room: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """For each k, the sums up to room that pieces of sizes[k:] can make, as the bits of a number."""
    mask = (1 << (room + 1)) - 1
    found = [1]
    for size in reversed(sizes):
        sums, left, step = found[-1], min(counts[size], room // size), 1
        while left:
            take = min(step, left)
            sums |= sums << (size * take)
            left -= take
            step *= 2
        found.append(sums & mask)
    return found[::-1]


def fillings(room: int, sizes: list[int], counts: dict[int, int], waste: int, price: int) -> Iterator[tuple[int, ...]]:
    """All fillings of room that leave at most ``waste`` and are not dominated, one after the other: those of the least sum of
    what they leave and ``price`` for each piece beyond the first come first, and of these those with the largest pieces, so that
    small ones stay to close later gaps. sizes: those left, descending. Dominated: a single piece fits exactly, or a size
    that is left could stand in for a smaller member."""
    if counts.get(room):
        yield (room,)
        return
    sizes = [x for x in sizes if x <= room]
    sums = reachable(room, sizes, counts)

    def exact(k: int, target: int) -> Iterator[tuple[int, ...]]:  # as deep as a bin has distinct sizes
        if not target:
            yield ()
            return
        for i in range(k, len(sizes)):
            if not sums[i] >> target & 1:
                return
            size = sizes[i]
            for n in range(min(counts[size], target // size), 0, -1):
                if sums[i + 1] >> (target - n * size) & 1:
                    for rest in exact(i + 1, target - n * size):
                        yield (size,) * n + rest

    have = set(sizes)
    spare, open_ = 0, []  # wastes are opened as their turn comes

    def ask(spare: int, found: Iterator[tuple[int, ...]]) -> None:
        chosen = next(found, None)
        if chosen is not None:
            heapq.heappush(open_, (spare + price * max(0, len(chosen) - 1), spare, chosen, found))

    while open_ or spare <= min(waste, room):
        while spare <= min(waste, room) and (not open_ or open_[0][0] >= spare):
            if sums[0] >> (room - spare) & 1:
                ask(spare, exact(0, room - spare))
            spare += 1
        if open_:
            _, left, chosen, found = heapq.heappop(open_)
            ask(left, found)
            used = Counter(chosen)
            if not left or not any(b in have and counts[b] > used[b] for a in used for b in range(a + 1, a + left + 1)):
                yield chosen


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound from below: all pieces' sum, and for each k what pieces above capacity - k and above half leave to those from k on."""
    best, sizes = -(-sum(k * v for k, v in counts.items()) // capacity), sorted(counts)
    for k in (x for x in [0, *sizes] if 2 * x <= capacity):
        alone = sum(counts[x] for x in sizes if x > capacity - k)
        large = [(x, counts[x]) for x in sizes if capacity < 2 * x <= 2 * (capacity - k)]
        small = sum(x * counts[x] for x in sizes if k <= x and 2 * x <= capacity)
        over = small - sum((capacity - x) * n for x, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-over // capacity)))
    return best


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, prices: tuple[int, ...] = (6, 0, 12, 3, 24, 8), budget: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns with multiplicities that pack counts[length] pieces of each length.

    Branch and bound by bin completion: the largest piece left opens a bin, each undominated filling around it is a branch,
    taken as often as the counts allow and, on the way back, half as often down to once. A branch is cut when the waste so far
    exceeds what an improvement on the incumbent may waste. The first incumbent is best-fit decreasing; each better packing
    tightens the bound and starts the search anew. ``prices`` order the branches in turn: what waste a piece is worth that stays
    for a later gap. It ends when the incumbent meets ``least_bins``, when all is searched (either proves it optimal), or
    after ``budget`` nodes of each order's last search with the best packing so far, which holds all pieces in any case.
    """
    counts = {k: v for k, v in counts.items() if v}
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    least = least_bins(counts, capacity)
    for price in prices:
        while used > least:
            found, complete = _better(counts, capacity, used, price, budget)
            if found is None and complete:
                return best
            if found is None:
                break
            best, used = found, sum(n for _, n in found)
    return best


def _better(counts: dict[int, int], capacity: int, used: int, price: int, budget: int) -> tuple[list | None, bool]:
    """A packing of fewer than ``used`` bins or None, and whether all was searched."""
    left, waste = dict(counts), 0
    allowed, nodes = (used - 1) * capacity - sum(k * v for k, v in counts.items()), 0
    path: list[tuple[tuple[int, ...], int]] = []

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        sizes = sorted((k for k, v in left.items() if v), reverse=True)
        spare = allowed - waste
        left[sizes[0]] -= 1
        free = dict(left)
        left[sizes[0]] += 1
        for chosen in fillings(capacity - sizes[0], sizes, free, spare, price):
            pattern = (sizes[0], *chosen)
            n = min(left[size] // k for size, k in Counter(pattern).items())
            if gap := capacity - sum(pattern):
                n = min(n, spare // gap)
            while n:
                yield pattern, n
                n //= 2

    branches = [options()]
    while branches and nodes < budget:
        branch = next(branches[-1], None)
        if branch is None:
            branches.pop()
            if path:
                pattern, n = path.pop()
                for size in pattern:
                    left[size] += n
                waste -= n * (capacity - sum(pattern))
            continue
        nodes += 1
        pattern, n = branch
        for size in pattern:
            left[size] -= n
        waste += n * (capacity - sum(pattern))
        path.append(branch)
        if not any(left.values()):
            return list(path), False
        branches.append(options())
    return None, not branches


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, in rank order, the first rank, first sequence and offset of each run of slots."""
    slots, next_rank, sequence = defaultdict(list), defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            slots[size].append((next_rank[size], sequence, offset))
            next_rank[size] += n
            offset += size
        sequence += n
    return slots


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """token_pieces of docs, each with sequence_id and offset: as few sequences of at most capacity tokens as
    complete_bins finds, gapless from 0. Pieces of full length get sequences of their own, with negative ids."""
    pieces = token_pieces(docs, vocabulary or default_vocabulary(), capacity, end)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    blocks = 16 + short.count() // 50_000  # of each length, so that no length is ranked by one task
    short = short.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    sizes = materialize(short.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # below capacity rows
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    slots = _slots(complete_bins(counts, capacity))  # below capacity rows; as many slots as there are patterns, whatever the corpus
    schema = T.StructType([T.StructField("length", T.LongType()), T.StructField("slots", T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("rank", "sequence", "offset")]), False))])
    slot_table = docs.sparkSession.createDataFrame(list(slots.items()), schema)
    ranked = short.join(broadcast_if_small(first, (capacity - 1) * blocks), ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1)
    slot = F.element_at(F.filter("slots", lambda s: s["rank"] <= F.col("rank")), -1)
    placed = ranked.join(broadcast_if_small(slot_table, sum(map(len, slots.values())), 200_000), "length").withColumn("slot", slot)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.filter(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(placed.select(*columns, (F.col("slot.sequence") + F.col("rank") - F.col("slot.rank")).alias("sequence_id"), F.col("slot.offset").alias("offset")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

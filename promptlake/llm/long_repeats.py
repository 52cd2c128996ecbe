"""Removal of long repeats: every byte under a string of ``window`` bytes that also starts earlier, by run-length indexes of suffix arrays.

1. Each window has an anchor: of the strings of ``anchor`` bytes in it, the one with the least hash, the first of equals. Windows in a row
   that share their anchor make a stretch; equal windows have equal anchors at equal places, so only stretches of one anchor can hold them.
2. Stretches are dealt out by their anchor as digests. A stretch equal to an earlier one repeats as a whole. An anchor with several different
   stretches asks for the first of each, as bytes.
3. Those stretches are dealt out by anchor to tasks. Each builds a run-compressed Burrows-Wheeler transform with the text places of its
   run ends, streams the matching statistics of later stretches against earlier ones, and marks matches of a window's length.
4. Marked spans meet the texts again.

A frequent anchor is no hot spot: stretches equal within a batch of texts are told apart from their first one on the spot; an anchor with more than
``few`` different stretches in a batch, or more than ``most`` over all, has its windows compared as rows by their digests instead, so
that no task ever holds an anchor's stretches beyond that, and none is dropped.

Defined cases: null and empty texts have no bytes; a text below the window's length keeps all; rows equal in doc_id and text are one document,
each with its result; rows of equal doc_id and different text come in the order of their texts' hashes; a null doc_id is less than all others; very long
texts are read in parts that overlap by a window; an empty table gives an empty result; other columns are not read.
Digests of stretches and windows have 128 bits: 64 of the anchor, 64 of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, materialize, release_shuffles

WINDOW, ANCHOR, FEW, MOST = 100, 24, 16, 64
PART = 4 << 20
#: With a stretch's number of windows, below this, its anchor's place after its first window's.
OFFSET = 1 << 12
STRETCH, SPAN, WINDOWS, MARK, FREQUENT = 0, 1, 2, 3, 4
NO_ID = np.iinfo(np.int64).min
FACTOR = 0x9E3779B97F4A7C15 | 1
WORD = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hash of the string of that many bytes at each place where one fits."""
    found: list[np.ndarray | None] = [None] * len(sizes)
    taken, size, h = [0] * len(sizes), 1, BYTE_VALUES[data]
    while size <= max(sizes):
        for k, whole in enumerate(sizes):
            if whole & size:
                rest = found[k]
                if rest is None:
                    found[k] = h
                else:
                    n = max(0, min(len(h), len(rest) - size))
                    found[k] = h[:n] * np.uint64(pow(FACTOR, taken[k], 1 << 64)) + rest[size : size + n]
                taken[k] += size
        h = h[: max(0, len(h) - size)] * np.uint64(pow(FACTOR, size, 1 << 64)) + h[size:]
        size *= 2
    return [_mixed(x) for x in found]


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of keys[i : i + width] at each place."""
    size, low = 1, keys
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (width - size)], low[width - size :]) if width > size else low


class Scan:
    """The stretches of texts laid end to end: first and last window, anchor hash, digest; and the digests of all windows."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        none = np.empty(0, np.int64)
        self.first = self.last = self.offset = none
        self.a = self.s = np.empty(0, np.uint64)
        if len(data) < window:
            return
        parts, self.windows = rolling(data, (anchor, window))
        bits = np.uint64(int(len(parts)).bit_length())
        keys = (parts >> bits << bits) | np.arange(len(parts), dtype=np.uint64)  # of equal hashes the first
        at = (least_of(keys, window - anchor + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        n = len(at)
        until = np.repeat(ends, np.diff(ends, prepend=0))[:n]
        fits = np.arange(n) + window <= until
        new = fits.copy()
        new[1:] &= ~fits[:-1] | (at[1:] != at[:-1])
        final = fits.copy()
        final[:-1] &= ~fits[1:] | (at[1:] != at[:-1])
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(final)
        self.a, self.offset = parts[at[self.first]], at[self.first] - self.first
        width = (self.last - self.first).astype(np.uint64)
        self.s = _mixed(self.windows[self.first] * np.uint64(FACTOR) + self.windows[self.last] + width * np.uint64(0xD6E8FEB86659FD93))


def _texts(batch: pa.RecordBatch, part: int = PART, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of a batch (text in its last column) of about ``part`` bytes: bytes end to end, where each piece ends, its row, and where it begins in its text."""
    rows, begins, pieces, total = [], [], [], 0
    for row, text in enumerate(batch.column(batch.num_columns - 1)):
        content = text.as_py()
        data = np.frombuffer(content.encode(), np.uint8) if content else ()
        for begin in range(0, max(1, len(data) - window + 1), part):
            if len(data) < window:
                break
            piece = data[begin : begin + part + window - 1]
            rows.append(row)
            begins.append(begin)
            pieces.append(piece)
            total += len(piece)
            if total >= part:
                yield np.concatenate(pieces), np.cumsum([*map(len, pieces)]), np.array(rows), np.array(begins)
                rows, begins, pieces, total = [], [], [], 0
    if pieces:
        yield np.concatenate(pieces), np.cumsum([*map(len, pieces)]), np.array(rows), np.array(begins)


def _longs(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a place of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each place the index of its group's first place."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


ROWS = "kind tinyint, a long, s long, doc_id long, th long, p long, c int"


def _rows(kind, a, s, doc, th, p, c) -> pa.RecordBatch:
    n = len(a)
    full = lambda x, t: np.broadcast_to(np.asarray(x, t), n).copy()
    columns = [full(kind, np.int8), np.asarray(a).astype(np.uint64).view(np.int64), full(s, np.uint64).view(np.int64), full(doc, np.int64), full(th, np.int64), full(p, np.int64), full(c, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "a", "s", "doc_id", "th", "p", "c"])


def _scan_rows(window: int, anchor: int, few: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = _longs(batch.column(0)), _longs(batch.column(1))
            for data, ends, rows, begins in _texts(batch, part, window):
                scan = Scan(data, ends, window, anchor)
                if not len(scan.first):
                    continue
                of = np.searchsorted(ends, scan.first, "right")
                doc, th = ids[rows[of]], hashes[rows[of]]
                base = np.concatenate([[0], ends[:-1]])
                p = scan.first - base[of] + begins[of]
                c = scan.last - scan.first + 1
                order = np.lexsort((p, th, doc, scan.s, scan.a))
                a, s, doc, th, p, c, first, offset = (x[order] for x in (scan.a, scan.s, doc, th, p, c, scan.first, scan.offset))
                own = _starts(a, s)
                f = _firsts(own)
                later = (doc != doc[f]) | (th != th[f]) | (p != p[f])
                yield _rows(SPAN, *(x[later] for x in (a, s, doc, th, p, c)))
                a, s, doc, th, p, c, first, offset = (x[own] for x in (a, s, doc, th, p, c, first, offset))
                new = _starts(a)
                group = np.cumsum(new) - 1
                hot = np.bincount(group)[group] > few
                cold = ~hot
                yield _rows(STRETCH, *(x[cold] for x in (a, s, doc, th, p, c + OFFSET * offset)))
                if hot.any():
                    marks = hot & new
                    yield _rows(MARK, a[marks], 0, NO_ID, 0, 0, 0)
                    a, doc, th, p, c, first = (x[hot] for x in (a, doc, th, p, c, first))
                    yield from _window_rows(scan.windows, a, doc, th, p, c, first)

    return run


def _window_rows(windows, a, doc, th, p, c, first) -> Iterator[pa.RecordBatch]:
    """A row for each different window of the stretches, its first one; the others as spans."""
    step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    wide = lambda x: np.repeat(x, c)
    s = windows[wide(first) + step]
    a, doc, th, p = wide(a), wide(doc), wide(th), wide(p) + step
    order = np.lexsort((p, th, doc, s, a))
    a, s, doc, th, p = (x[order] for x in (a, s, doc, th, p))
    own = _starts(a, s)
    f = _firsts(own)
    yield _rows(WINDOWS, *(x[own] for x in (a, s, doc, th, p)), 1)
    later = (doc != doc[f]) | (th != th[f]) | (p != p[f])
    a, doc, th, p = (x[later] for x in (a, doc, th, p))
    order = np.lexsort((p, th, doc))
    a, doc, th, p = (x[order] for x in (a, doc, th, p))
    new = _starts(doc, th, p - np.arange(len(p)))  # windows in a row are one span
    at = np.flatnonzero(new)
    yield _rows(SPAN, a[at], 0, doc[at], th[at], p[at], np.diff(np.append(at, len(p))))


def _dealt(most: int):
    """Of a bucket's stretches: those equal to an earlier one as spans; of anchors with several different ones the first of each,
    to be compared as bytes (STRETCH) or, of frequent anchors, window by window (FREQUENT). Other rows pass."""
    def run(whole: pa.Table) -> pa.Table:
        known = pc.is_in(whole.column("kind"), pa.array([SPAN, WINDOWS], pa.int8()))
        rows = whole.filter(pc.invert(known))
        columns = {c: rows.column(c).to_numpy() for c in ("kind", "a", "s", "doc_id", "th", "p", "c")}
        order = np.lexsort([columns[c] for c in ("p", "th", "doc_id", "s", "kind", "a")])
        kind, a, s, doc, th, p, c = (columns[x][order] for x in ("kind", "a", "s", "doc_id", "th", "p", "c"))
        own = _starts(a, kind, s)
        f = _firsts(own)
        real = kind == STRETCH
        later = real & ((doc != doc[f]) | (th != th[f]) | (p != p[f]))
        group = np.cumsum(_starts(a)) - 1
        different = np.bincount(group, own & real)[group]
        hot = (np.bincount(group, ~real)[group] > 0) | (different > most)
        asked = real & own & (hot | (different > 1))
        spans = _rows(SPAN, *(x[later] for x in (a, s, doc, th, p, c % OFFSET)))
        wanted = _rows(np.where(hot[asked], FREQUENT, STRETCH), *(x[asked] for x in (a, s, doc, th, p, c)))
        return pa.concat_tables([whole.filter(known).select(spans.schema.names).cast(spans.schema), pa.Table.from_batches([spans, wanted])])

    return run


def _fetched(window: int):
    """The bytes of asked stretches (STRETCH), and the digests of the windows of frequent anchors' (WINDOWS), or spans."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("s", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("p", pa.int64()), ("c", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                parts, plain, hot, pieces = [], [], [], []
                for doc, th, asked, text in zip(_longs(batch.column(0)), _longs(batch.column(1)), batch.column(2), batch.column(3)):
                    data = text.as_py().encode()
                    asked = asked.values
                    kind, a, p, c = (asked.field(k).to_numpy(zero_copy_only=False) for k in ("kind", "a", "p", "c"))
                    for k, own, x, n in zip(kind.tolist(), a.tolist(), p.tolist(), c.tolist()):
                        content = data[x : x + n % OFFSET - 1 + window]
                        (plain if k == STRETCH else hot).append((own, n // OFFSET, doc, th, x, n % OFFSET))
                        (parts if k == STRETCH else pieces).append(content)
                out = _rows(STRETCH, *np.array(plain, np.int64).reshape(-1, 6).T)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(parts, pa.binary())], schema=schema)
                if hot:
                    a, _, doc, th, p, c = np.array(hot, np.int64).T
                    first = np.cumsum([0, *map(len, pieces)])[:-1]
                    windows = rolling(np.frombuffer(b"".join(pieces), np.uint8), (window,))[0]
                    for out in _window_rows(windows, a, doc, th, p, c, first):
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], schema=schema)

    return run


class RunIndex:
    """Burrows-Wheeler transform of strings, in runs: each run's symbol and first row, and the text places of its first and last row.

    ``text`` has symbols above 0 and a 0 behind each string; zeros differ, the earlier the less. ``places`` tells where a string lies in the text.
    """

    def __init__(self, text: np.ndarray):
        self.text = text
        first = first_ranks(text)
        self.same, self.step = first[1], first[3]  # equal where so many symbols agree
        order = suffix_order(text, first)
        before = text[order - 1]  # of the first suffix the text's last symbol, a 0
        new = _starts(before)
        self.starts = np.flatnonzero(new)
        self.symbols = before[self.starts]
        last = np.append(self.starts[1:], len(order)) - 1
        self.first_place, self.last_place, self.lasts = order[self.starts] - 1, order[last] - 1, last
        lengths = last - self.starts + 1
        self.by_symbol = np.lexsort((np.arange(len(self.starts)), self.symbols))
        sorted_symbols = self.symbols[self.by_symbol]
        self.keys = sorted_symbols * (len(self.starts) + 1) + self.by_symbol
        done = np.cumsum(lengths[self.by_symbol]) - lengths[self.by_symbol]
        self.rank = np.empty(len(self.starts), np.int64)  # rows of smaller symbols, and of this one in earlier runs: where LF leads a run's first row
        self.rank[self.by_symbol] = done

    def neighbours(self, run: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest runs of the symbol not after and after the run; -1 where there is none."""
        k = np.searchsorted(self.keys, symbol * (len(self.starts) + 1) + run, "right")
        up, down = np.maximum(k - 1, 0), np.minimum(k, len(self.keys) - 1)
        above = np.where((k > 0) & (self.symbols[self.by_symbol[up]] == symbol), self.by_symbol[up], -1)
        below = np.where((k < len(self.keys)) & (self.symbols[self.by_symbol[down]] == symbol), self.by_symbol[down], -1)
        return above, below

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at x and y share, up to most; a 0 ends both."""
        found, active = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
        while len(active):  # in strides of as many symbols as equal ranks tell
            active = active[self.same[x[active] + found[active]] == self.same[y[active] + found[active]]]
            found[active] += self.step
            active = active[found[active] < most[active]]
        active = np.flatnonzero(found < most)
        for _ in range(self.step - 1):
            at, to = x[active] + found[active], y[active] + found[active]
            active = active[(self.text[at] == self.text[to]) & (self.text[at] > 0)]
            found[active] += 1
            active = active[found[active] < most[active]]
        return np.minimum(found, most)

    def statistics(self, queries: np.ndarray, ends: np.ndarray, cap: int) -> np.ndarray:
        """For each symbol of the queries, laid end to end, the length up to cap of the longest match that begins there. All queries go
        from right to left in step; each holds a row of the transform, that row's text place, and the length matched."""
        lengths = np.diff(ends, prepend=0)
        found = np.zeros(len(queries), np.int64)
        m = len(lengths)
        row, place, length = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero(lengths >= step)
            at = ends[on] - step
            symbol, r, x, n = queries[at], row[on], place[on], length[on]
            run = np.searchsorted(self.starts, r, "right") - 1
            stays = (self.symbols[run] == symbol) & (n > 0)
            jump = np.flatnonzero(~stays)
            to, nx, nn = run.copy(), x - 1, n + 1
            nr = self.rank[run] + (r - self.starts[run])
            if len(jump):
                above, below = self.neighbours(run[jump], symbol[jump])
                none = (above < 0) & (below < 0)
                up, down = self.last_place[above] + 1, self.first_place[below] + 1  # what the rows' suffixes begin with comes after the symbol
                fits_up = np.where(above >= 0, self.common(up, x[jump], np.where(above >= 0, n[jump], 0)), -1)
                fits_down = np.where(below >= 0, self.common(down, x[jump], np.where(below >= 0, n[jump], 0)), -1)
                higher = fits_up >= fits_down
                to[jump] = np.where(higher, above, below)
                nr[jump] = np.where(none, 0, np.where(higher, self.rank[above] + (self.lasts[above] - self.starts[above]), self.rank[below]))
                nx[jump] = np.where(none, 0, np.where(higher, up, down) - 1)
                nn[jump] = np.where(none, 0, np.where(higher, fits_up, fits_down) + 1)
            nn = np.minimum(nn, cap)
            row[on], place[on], length[on] = nr, nx, nn
            found[at] = nn
        return found


def first_ranks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes in order by their first ``size`` symbols, each one's rank, which places of the order begin a new rank, and size. A suffix
    that a 0 ends within these has a rank of its own."""
    present = np.zeros(int(text.max(initial=0)) + 1, np.int64)
    present[text] = 1
    present[0] = 0
    dense = np.cumsum(present)
    bits, size, key = int(dense[-1]).bit_length(), 1, np.where(text > 0, dense[text], 0)
    ended = text == 0
    while 2 * size * bits <= 62 and size < 8:
        after, off = np.zeros_like(key), np.ones_like(ended)
        after[:-size], off[:-size] = key[size:], ended[size:]
        key = key << (bits * size) | np.where(ended, 0, after)
        ended = ended | off
        size *= 2
    order = np.argsort(key, kind="stable")
    new = _starts(key[order]) | ended[order]
    rank = np.empty(len(text), np.int64)
    rank[order] = _firsts(new)
    return order, rank, new, size


def suffix_order(text: np.ndarray, first: tuple | None = None) -> np.ndarray:
    """Suffixes in order by doubling ranks, of which only those still equal to a neighbour are sorted again; a 0 ends a suffix's comparison, as zeros differ by place."""
    order, rank, new, size = first or first_ranks(text)
    order, rank, n = order.copy(), rank.copy(), len(text)
    alone = new & np.append(new[1:], True)
    places = np.flatnonzero(~alone)
    while len(places):
        at = order[places]
        key = rank[at] * (n + 1) + np.where(at + size < n, rank[np.minimum(at + size, n - 1)] + 1, 0)
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[places] = at
        new = _starts(key)
        rank[at] = places[_firsts(new)]
        places = places[~(new & np.append(new[1:], True))]
        size *= 2
    return order


def later_matches(strings: list[bytes], group: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(string, from, to) where windows that begin in from to to (not included) also lie in an earlier string of the same group. Strings come in
    order, with equal groups together. Of two strings in a group the places differ first in some bit; for each bit those
    without it are indexed and those with it streamed, under symbols that tell the higher bits apart."""
    at = np.arange(len(strings)) - _firsts(_starts(group))
    counts = np.bincount(np.cumsum(_starts(group)) - 1)
    size = counts[np.cumsum(_starts(group)) - 1]
    arrays = [np.frombuffer(x, np.uint8).astype(np.int64) for x in strings]
    bit = 0
    while size.max(initial=0) > 1 << bit:
        block = at >> (bit + 1)
        has = (at >> bit & 1).astype(bool)
        streamed = np.flatnonzero(has)
        used = ~has & (size > (block << (bit + 1)) + (1 << bit))  # some string with the bit follows in its block
        indexed = np.flatnonzero(used)
        tag = lambda k: arrays[k] + 1 + 256 * int(block[k])
        index = RunIndex(np.concatenate([x for k in indexed for x in (tag(k), np.zeros(1, np.int64))]))
        queries = [tag(k) for k in streamed]
        ends = np.cumsum([*map(len, queries)])
        hits = (index.statistics(np.concatenate(queries), ends, window) >= window).astype(np.int8)
        for k, end in zip(streamed, ends):
            own = hits[end - len(arrays[k]) : end]
            if own.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
                for x, y in edges.reshape(-1, 2).tolist():
                    yield int(k), x, y
        bit += 1


def can_match(strings: list[bytes], group: np.ndarray, offset: np.ndarray, window: int, anchor: int, pieces: int = 4) -> np.ndarray:
    """Whether a string agrees with another of its group on one of a few pieces around the anchor. Windows of equal anchors that are
    equal have the anchor at the same place, so each contains the piece that belongs to this place's range."""
    free = window - anchor
    width = free // pieces + 1
    may = np.zeros(len(strings), bool)
    for low in range(0, free + 1, width):
        high = min(free, low + width - 1)  # bytes before the anchor in the windows meant
        known: dict[tuple[int, bytes], int] = {}
        for k, (s, g, at) in enumerate(zip(strings, group.tolist(), offset.tolist())):
            if at >= low and at + anchor + free - high <= len(s):
                other = known.setdefault((g, s[at - low : at + anchor + free - high]), k)
                if other != k:
                    may[k] = may[other] = True
    return may


def _matched(window: int, anchor: int):
    def run(rows: pa.Table) -> pa.Table:
        a, doc, th, p, offset = (rows.column(c).to_numpy() for c in ("a", "doc_id", "th", "p", "s"))
        order = np.lexsort((p, th, doc, a))
        own = _starts(*(x[order] for x in (a, doc, th, p)))
        order = order[own]  # rows of equal documents once
        order = order[can_match(rows.column("bytes").take(pa.array(order)).to_pylist(), a[order], offset[order], window, anchor)]
        strings = rows.column("bytes").take(pa.array(order)).to_pylist()
        a, doc, th, p = (x[order] for x in (a, doc, th, p))
        found = np.array([*later_matches(strings, a, window)], np.int64).reshape(-1, 3)
        k = found[:, 0]
        return pa.Table.from_batches([_rows(SPAN, a[k], 0, doc[k], th[k], p[k] + found[:, 1], found[:, 2] - found[:, 1])])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                runs: list[list[int]] = []
                for x in sorted((s["p"], s["p"] + s["c"] - 1 + window) for s in spans or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                digest, at = hashlib.sha256(), 0
                for begin, end in runs:
                    digest.update(data[at:begin])
                    at = end
                digest.update(data[at:])
                out.append((len(data), sum(y - x for x, y in runs), len(runs), digest.hexdigest(), [{"begin": x, "end": y} for x, y in runs]))
            counts = np.array([x[:3] for x in out], np.int64).reshape(-1, 3).T
            removed = pa.array([x[4] for x in out], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array([x[3] for x in out], pa.string()), removed], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def later_windows(rows: DataFrame) -> DataFrame:
    """Of rows of windows (a, s, doc_id, th, p, and more) those that are equal to an earlier one, as spans. They are exchanged once, without what all share; a portion
    of texts has each window once, so that equal ones are no more than there are portions."""
    place = F.struct("doc_id", "th", "p")
    first = F.min(place).over(Window.partitionBy("a", "s"))
    known = rows.select("a", "s", "doc_id", "th", "p").withColumn("first", first)
    return known.filter(place > F.col("first")).select("doc_id", "th", "p", F.lit(1).alias("c"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, few: int = FEW, most: int = MOST, part: int = PART, bytes_a_task: int = 5_000_000, strings_a_task: int = 8_000) -> DataFrame:
    """doc_id, th (the text's hash), p, c: c windows from place p on that also start earlier; in any order, some more than once. A null doc_id is NO_ID."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), "text").filter(F.octet_length("text") >= window)
    # a stretch for about (window - anchor) / 2 bytes; other rows are dealt out by their place, so that no anchor's windows meet in one task
    tasks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bytes_a_task
    scanned = texts.mapInArrow(_scan_rows(window, anchor, few, part), ROWS)
    by = F.when(F.col("kind").isin(STRETCH, MARK), F.pmod("a", F.lit(tasks))).otherwise(F.pmod(F.xxhash64("doc_id", "th", "p"), F.lit(tasks)))
    asked = materialize(scanned.groupBy(by.alias("task")).applyInArrow(_dealt(most), ROWS), "asked-stretches")
    release_shuffles(spark)
    by_text = asked.filter(F.col("kind").isin(STRETCH, FREQUENT)).groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "a", "p", "c")).alias("asked"))
    fetched = texts.join(by_text, ["doc_id", "th"]).select("doc_id", "th", "asked", "text").mapInArrow(_fetched(window), f"{ROWS}, bytes binary")
    fetched = materialize(fetched, "stretch-bytes")
    release_shuffles(spark)
    strings = fetched.filter(F.col("kind") == STRETCH)
    tasks = 1 + strings.count() // strings_a_task
    matched = strings.groupBy(F.pmod("a", F.lit(tasks)).alias("task")).applyInArrow(_matched(window, anchor), ROWS)
    rows = asked.filter(F.col("kind") == WINDOWS).unionByName(fetched.drop("bytes").filter(F.col("kind") == WINDOWS))
    compared = later_windows(rows)
    columns = ["doc_id", "th", "p", "c"]
    found = matched.select(columns).unionByName(compared.select(columns))
    for known in (asked, fetched):
        found = found.unionByName(known.filter(F.col("kind") == SPAN).select(columns))
    found = materialize(found, "repeats")
    discard(asked, fetched)
    release_shuffles(spark)
    return found


def without_repeats(docs: DataFrame, window: int = WINDOW, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs of bytes (begin, end) of each row."""
    spans = repeated_spans(docs, window, **limits).groupBy("doc_id", "th").agg(F.collect_list(F.struct("p", "c")).alias("spans"))
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("th"))
    joined = keyed.join(spans.withColumnRenamed("doc_id", "_id"), ["_id", "th"], "left").select("doc_id", "spans", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_kept(window), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin:long,end:long>>")


def op11_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))

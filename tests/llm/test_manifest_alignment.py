"""Merkle manifest and tokenizer alignment: against SQL and plain readings, with their edge cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import compare
from promptlake.llm import merkle_manifest as mm
from promptlake.llm import token_alignment as ta
from promptlake.llm.common import documents, ends_up_to

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, row long, path string"
EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", None, "a"), (5, "one", "en", "a"), (5, "one", "en", "a"), (6, "One two\nthree four", "en", "a"),
    (7, "<s> one <|endoftext|> </s>", "en", "c"), (8, "x" * 3000, "en", "a"), (9, "漢字 仮名 😀 é ﬁn\x00", "zz", "é"), (10, "the cat sat. " * 2500, "en", "a"), (11, "a ▁ b", "en", "a"), (None, "no id\n", "en", "a"),
    (12, " " * 60_000 + "x", "en", "a"), (13, "a  b \n c\td\xa0e \u2003f \x1c g  ", "en", "a"), (14, " lead and trail ", "en", "a"), (15, "don't 's x'll 12,345.67 ...", "en", "a"),
]


def frame(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 1, 2, "x") for i, t, lang, src in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and for each leaf its siblings level by level as (before, after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        level, at = [h(*level[k : k + 3]) for k in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def brute_manifest(rows):
    def leaf(*fields):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))

    sources = defaultdict(list)
    for i, text, lang, source, n in rows:
        changed = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        sources[source].append((i is not None, i or 0, leaf(i, source, lang, n, text), leaf(i, source, lang, n, changed), i))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    lower = {s: tree([x[2] for x in sorted(sources[s])]) for s in order}
    root, upper = tree([lower[s][0] for s in order])
    for s, shared in zip(order, upper):
        for x, path in zip(sorted(sources[s]), lower[s][1]):
            folded = x[3]
            for before, after in path + shared:
                folded = h(before, folded, after)
            yield x[4], x[2], lower[s][0], root, h(*(b + a for b, a in path + shared)), folded, folded == root


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_plain_trees(spark, height):
    """Blocks of 3 and 9 leaves go through several rounds; one of 3^7 holds each source whole."""
    rows = [*EDGES, *((100 + k, f"text {k}\n" * (k % 3), "en", f"s{k % 5}") for k in range(90)), *((300 + k, "t", None, "hot") for k in range(83))]
    found = [tuple(r) for r in mm.manifest(frame(spark, rows), height).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_manifest([(*x, len(x[1] or "")) for x in rows])))


def test_manifest_matches_sql(spark, sf_dir):
    compare.same_rows(spark, sf_dir, mm.op12_merkle_manifest, mm.OP12_SQL)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 10, 27, 80, 243])
def test_traversal_has_each_leafs_run_with_few_nodes_kept(n):
    leaves, height = [h(str(k)) for k in range(n)], mm.height_of(n)
    _, paths = tree(leaves)
    for i, steps in enumerate(mm.traverse(leaves, height)):
        assert [("".join(r[:at]), "".join(r[at + 1 :])) for r, at in steps] == paths[i]


def test_treehash_stacks_stay_small_and_are_ready_in_time(monkeypatch):
    """Nodes on all stacks grow with the height; no run is waited for once the first ones are there."""
    height = 6
    most, waited, made = 0, 0, []
    start, finish = mm.Treehash.__init__, mm.Treehash.finish
    monkeypatch.setattr(mm.Treehash, "__init__", lambda self, *a: (start(self, *a), made.append(self))[0])

    def watched(self):
        nonlocal waited
        waited += self.next < self.stop and self.next > 0
        return finish(self)

    monkeypatch.setattr(mm.Treehash, "finish", watched)
    for _ in mm.traverse([h(str(k)) for k in range(3**height)], height):
        made = [t for t in made if t.next < t.stop]
        most = max(most, sum(len(r) for t in made for r in t.runs))
    assert most <= 8 * height and waited == 0


def test_manifest_of_an_empty_table(spark):
    assert mm.manifest(frame(spark, [])).collect() == []


# --- tokenizer alignment


def brute_alignment(rows):
    """The two libraries as the contract names them, and a merge of the two lists of tokens."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
    read = []
    for i, text in rows:
        groups, target = [], (" " + (text or "")).encode()
        a, b = own.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        a_bytes = [bytes(shown[c] for c in own.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(a_bytes) != target or b"".join(b_bytes) != target:
            a, b = [], []
        at, ends, group = [0, 0], [0, 0], ([], [])
        while at[0] < len(a) or at[1] < len(b):
            side = 0 if ends[0] <= ends[1] and at[0] < len(a) else 1
            group[side].append((a, b)[side][at[side]])
            ends[side] += len((a_bytes, b_bytes)[side][at[side]])
            at[side] += 1
            if ends[0] == ends[1]:
                groups.append(group)
                group = ([], [])
        read.append((i, len(a), len(b), groups, [(x, y) for ga, gb in groups for x in ga for y in gb]))
    counts = Counter(pair for *_, links in read for pair in set(links))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    for i, n_a, n_b, groups, links in read:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield i, n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links), h(text) if groups else ""


def test_alignment_edges(spark):
    want = sorted(map(str, brute_alignment([x[:2] for x in EDGES])))
    for portion in (ta.PORTION, 50, 1):
        assert sorted(map(str, (tuple(r) for r in ta.align(frame(spark), portion=portion).collect()))) == want
    assert ta.align(frame(spark, [])).collect() == []


def test_alignment_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert sorted(tuple(r) for r in ta.op13_token_alignment(spark, sf_dir).collect()) == sorted(brute_alignment(rows))


def test_no_token_crosses_a_blank():
    """What makes units independent: no entry of a vocabulary has a blank between characters that are none."""
    for _, known in ta._sides(ta.default_vocabulary(), ta.default_pieces()):
        assert not [x for x in known if ta.BLANK.search(x.decode("utf-8", "replace"))]


def test_common_ends_are_placed(spark):
    df = spark.createDataFrame([([1, 3, 4, 9], [3, 9]), ([5], [5]), ([], [])], "ends array<int>, common array<int>")
    assert [r[0] for r in df.select(ends_up_to(F.col("ends"), F.col("common"))).collect()] == [[2, 4], [1], []]

"""The operators against brute force, round trips and held-out accuracy; edge cases of each."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from promptlake.llm import fingerprints as fp
from promptlake.llm import html_extract as he
from promptlake.llm import jaccard_join as jj
from promptlake.llm import language_id as li
from promptlake.llm import lm_scoring as lm
from promptlake.llm import packing as pk
from promptlake.llm import preference as pr
from promptlake.llm import quality_classifier as qc
from promptlake.llm import quality_rules as qr
from promptlake.llm import sentencepiece_lattice as sl
from promptlake.llm.common import documents, table
from promptlake.llm.queries import SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, row long, piece int"
#: Nulls, empty and blank texts, repeats, ties, a long text, a text without spaces, other scripts.
EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", None, "a"), (5, "one", "en", "a"), (5, "one", "en", "a"), (6, "One two\nthree four five six", "en", "a"),
    (7, "one TWO three\tfour five  six", "en", "a"), (8, "x" * 3000, "en", "a"), (9, "漢字 仮名 😀 é ﬁn", "zz", "a"), (10, "the cat sat. " * 2500, "en", "a"), (11, "123 456 !!", "en", "a"),
]


def frame(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1, 2) for i, t, lang, src in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- quality rules


def base(text):
    w = words_of(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if windows[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in qr.quality_rules(docs, min_rows=40).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts[r.doc_id])
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.kept and r.base_failed)


def test_quality_rules_reject_an_outlier(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}q" for i in range(5000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(80, 200))), "en", "s") for i in range(300)]
    rows += [(300 + i, " ".join(rng.choice(vocabulary) + "%%%" for _ in range(120)), "en", "s") for i in range(5)]
    kept = {r.doc_id: r.kept for r in qr.quality_rules(frame(spark, rows)).collect()}
    assert not any(kept[300 + i] for i in range(5)) and sum(kept[i] for i in range(300)) >= 298


def test_quality_rules_edges(spark):
    rows = qr.quality_rules(frame(spark)).collect()
    texts = {i: t for i, t, _, _ in EDGES}
    assert len(rows) == len(EDGES) and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]) for r in rows)
    assert qr.quality_rules(frame(spark, [])).count() == 0


# --- fingerprints


def paragraphs(text):
    found = set()
    for line in (text or "").split("\n"):
        for x in re.split("(?<=[.!?]) ", line):
            if x.strip(" \t\n\x0b\f\r"):
                found.add(x.strip(" \t\n\x0b\f\r"))
    return found


@pytest.mark.parametrize("edges", (False, True))
def test_fingerprints(spark, sf_dir, edges):
    docs = frame(spark, [x for k, x in enumerate(EDGES) if k != 5]) if edges else documents(spark, sf_dir)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    out = {r.doc_id: r for r in fp.document_fingerprints(docs).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(text)
        assert math.isclose(out[i].near_edited, jaccard(paragraphs(text), paragraphs(edited)))
        assert math.isclose(out[i].near_next, jaccard(paragraphs(text), paragraphs(after)))


def peeled(a, b):
    """How many digests differ between two fingerprints, by peeling what they say; None where their tables do not peel."""
    import xxhash

    def read(x):
        cells = [c.split(".") if c else ("0", "0", "0") for c in x.split(":")[1].split(",")]
        return [[(int(n, 16) + 2**31) % 2**32 - 2**31, int(k, 16), int(c, 16)] for n, k, c in cells]

    x, y = read(a), read(b)
    if len(x) != len(y):
        return None
    cells = [[n - m, k ^ q, c ^ d] for (n, k, c), (m, q, d) in zip(x, y)]
    check = lambda key: xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
    found = 0
    while any(n or k or c for n, k, c in cells):
        single = next(((t, n, k) for t, (n, k, c) in enumerate(cells) if abs(n) == 1 and check(k) == c), None)
        if single is None:
            return None
        at, n, key = single
        signed = key - 2**64 if key >= 2**63 else key
        for j, bits in enumerate((signed, key >> 21, key >> 42)):
            cell = cells[at // 24 * 24 + 8 * j + bits % 8]
            cell[0], cell[1], cell[2] = cell[0] - n, cell[1] ^ key, cell[2] ^ check(key)
        found += 1
    return found


def test_likeness_is_told_by_the_returned_fingerprints(spark, sf_dir):
    """Of equal texts they are equal, and where the difference is small, what the strings say gives the likeness."""
    told, by_text = 0, defaultdict(set)
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    for r in fp.document_fingerprints(documents(spark, sf_dir)).collect():
        by_text[texts[r.doc_id]].add(r.fingerprint)
        both = sum(int(x.split(":")[0]) for x in (r.fingerprint, r.edited_fingerprint))
        d = peeled(r.fingerprint, r.edited_fingerprint)
        if d is not None and both:
            told += 1
            assert math.isclose(r.near_edited, (both - d) / (both + d))
    assert told > 20 and all(len(x) == 1 for x in by_text.values())


def test_retries_with_other_hashes(spark, monkeypatch):
    """Tables too narrow to peel, then seeded ones that do."""
    monkeypatch.setattr(fp, "RETRIES", ((1, 0), (2, 1), (64, 2)))
    rows = [(i, "\n".join(f"line {j} of {i if j % 3 else 0}" for j in range(15 * i)), "en", "a") for i in range(6)]
    out = {r.doc_id: r for r in fp.document_fingerprints(frame(spark, rows)).collect()}
    for k, (i, text, *_) in enumerate(rows):
        a, b = paragraphs(text), paragraphs(rows[(k + 1) % 6][1])
        assert math.isclose(out[i].near_next, len(a & b) / len(a | b) if a | b else 1.0)


@pytest.mark.parametrize("length", (200, 700, 790, 810, 900, 1600))
def test_fingerprints_of_one_line(spark, length):
    """An edit of half a line leaves the other half's sentences in common, on both sides of 800 characters and across."""
    rows = [(i, "".join(f"Sentence {k} of text {i} ends here. " for k in range(200))[: length if i % 2 else 400], "en", "a") for i in range(6)]
    out = fp.document_fingerprints(frame(spark, rows)).collect()
    assert len(out) == 6 and all(0 < r.near_edited < 1 and r.near_next == 0 for r in out)


def test_next_row_across_ranges(spark):
    rows = spark.createDataFrame([(i * i, str(i)) for i in range(100)], "doc_id long, text string")
    out = {r.text: r.next_text for r in fp.with_next(rows, ["text"], rows_each=7).collect()}
    assert out == {str(i): str((i + 1) % 100) for i in range(100)}


def test_fingerprints_empty(spark):
    assert fp.document_fingerprints(frame(spark, [])).count() == 0


# --- Jaccard join


def brute_components(rows, n=4, percent=85):
    sets = {}
    for i, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    holders, shared, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i in sorted(sets):
        for x in sets[i]:
            holders[x].append(i)
    for ids in holders.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def families(seed):
    rng, rows = random.Random(seed), []
    for _ in range(25):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 20, 40, 90]))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("few", (1, 6, 16))
def test_jaccard_join(spark, few):
    rows = families(few)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(frame(spark, rows), few=few).collect()}
    assert got == brute_components([x[:2] for x in rows])


def test_jaccard_join_keeps_links_under_neighbourhoods(spark):
    """Thirty variants of each base, which comes last: they link with the base only, and often under bare segments."""
    rows = []
    for base, size in enumerate([9] * 12 + [10, 11, 12, 14, 16, 18, 20, 24]):
        words = [f"b{base}w{k}" for k in range(size)]
        rows += [(len(rows) + v, " ".join([*words, f"b{base}v{v}"]), "en", "a") for v in range(30)]
        rows.append((len(rows), " ".join(words), "en", "a"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(frame(spark, rows)).collect()}
    assert got == brute_components([x[:2] for x in rows])


@pytest.mark.parametrize(("few", "rounds"), [(1, 0), (1, 3), (3, 1), (16, 3)])
def test_refinement_alone_finds_all_links(spark, few, rounds):
    """Without any pivot's links: texts around passages and many edits of one text, all taken as open."""
    rng, rows = random.Random(few), families(7)
    for family in range(3):
        words = [f"p{family}w{k}" for k in range(60)]
        for v in range(30):
            if v % 2:  # edits
                w = [x if rng.random() > 0.03 else f"e{family}{v}{k}" for k, x in enumerate(words)]
            else:  # a passage with words of the text's own
                w = [*words, *(f"o{family}x{v}x{k}" for k in range(rng.randint(0, 14)))]
            rows.append((len(rows), " ".join(w), "en", "a"))
    docs = frame(spark, rows).select("doc_id", "text")
    grams = jj._grams(docs, 4, "bigint").distinct()
    least = grams.groupBy("grams").agg(F.min("node").alias("node")).select("node", "grams").cache()
    links = jj._Links(least, 85)
    links.check(least.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b")))
    jj._refine(least.select("node"), links, 85, few, rounds)
    found = {r.node: r.component for r in links.labels.collect()}
    want = brute_components([x[:2] for x in rows])
    assert {r.node: found.get(r.node, r.node) for r in least.collect()} == {r.node: want[r.node][1] for r in least.collect()}


def test_jaccard_join_one_large_group(spark):
    """5,000 near copies of one text, each with edits of its own, and texts that share its passage; all pairs by one product."""
    rng = random.Random(3)
    base, rows = [f"w{k}" for k in range(120)], []
    for v in range(5000):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3, 4])):
            w[k] = f"e{v}x{k}"
        rows.append((v, " ".join(w), "en", "a"))
    rows += [(5000 + v, " ".join([*base[:80], *(f"o{v}x{k}" for k in range(rng.randint(5, 25)))]), "en", "a") for v in range(60)]
    sets = [{tuple(x[k : k + 4]) for k in range(len(x) - 3)} for x in (t.split() for _, t, _, _ in rows)]
    often = [g for g, n in Counter(g for x in sets for g in x).items() if n > 1]
    has = np.array([[g in x for g in often] for x in sets], np.float32)
    both, size = has @ has.T, np.array([len(x) for x in sets])
    linked = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)  # shingles of one text alone are not in ``has``
    at = np.arange(len(rows))
    while (now := np.where(linked, at[None, :], len(rows)).min(1)).tolist() != at.tolist():
        at = now
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(frame(spark, rows)).collect()}
    assert got == {i: (int(size[i]), int(at[i])) for i in range(len(rows))}


def test_jaccard_join_edges(spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_join(frame(spark)).collect())
    want = brute_components([x[:2] for x in EDGES])
    assert got == sorted((i, *want[i]) for i, *_ in EDGES)
    assert jj.jaccard_join(frame(spark, [])).count() == 0


def test_signatures_meet():
    """Linked sets share a signature, at every size: the pigeonhole argument, on random pairs at the threshold."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 6, 7, 13, 30, 100, 400):
        for _ in range(20):
            extra = int(size * 15 / 85)
            both = rng.integers(0, 2**63, size).astype(np.uint64)
            a = np.unique(np.concatenate((both, rng.integers(0, 2**63, extra // 2).astype(np.uint64))))
            b = np.unique(np.concatenate((both, rng.integers(0, 2**63, extra - extra // 2).astype(np.uint64))))
            assert len(np.intersect1d(jj.signatures(a, 85), jj.signatures(b, 85)))


# --- packing


def check_packing(out, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pk.default_vocabulary())
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        found = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.length for r in found) == len(ids) and [r.piece for r in found] == list(range(len(found)))
        for r in found:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert len(found) == -(-len(ids) // 1024) and all(r.length == 1024 for r in found[1:])
    return len(bins)


def test_packing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = pk.pack(docs).collect()
    used = check_packing(out, {r.doc_id: r.text for r in docs.collect()})
    assert used <= -(-sum(r.length for r in out) // 1024) + 2


def test_packing_edges(spark):
    check_packing([r for r in pk.pack(frame(spark, EDGES[:5] + EDGES[6:])).collect()], {i: t for i, t, _, _ in EDGES})
    assert pk.pack(frame(spark)).count() == pk.pack(frame(spark, EDGES[:5] + EDGES[6:])).count() + 1
    assert pk.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["before <|endoftext|> after", "a" + " " * 49_999 + "b", " " * 50_000 + "x", "a" + " " * 50_001 + "b", "\n \t" * 30_000, "a" + " " * 1_000_000 + "b"])
def test_ids_are_those_of_the_tokenizers_library(text):
    """With an added token in the text, and on both sides of the length at which runs of white space go to the library."""
    from tokenizers import Tokenizer

    assert pk._encoder(pk.default_vocabulary())(text) == Tokenizer.from_file(pk.default_vocabulary()).encode(text, add_special_tokens=False).ids


def test_packing_beats_best_fit(spark):
    """The lengths of sf0.01's documents, which best-fit decreasing packs into more bins than the bound that the search meets."""
    lengths = pk.token_pieces(documents(spark, "/root/testdata/sf0.01"), pk.default_vocabulary()).groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in lengths if r["length"] < 1024}
    found = pk.complete_bins(counts)
    packed = Counter()
    for pattern, n in found:
        assert sum(pattern) <= 1024
        packed.update({size: n * k for size, k in Counter(pattern).items()})
    assert packed == counts and sum(n for _, n in found) == pk.least_bins(counts, 1024) < sum(n for _, n in pk.best_fit(counts, 1024))


def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= sizes[k]:
                rest = list(bins)
                rest[rest.index(room)] -= sizes[k]
                place(k + 1, rest)
        place(k + 1, [*bins, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 30) for _ in range(9)), reverse=True)
        packed = pk.complete_bins(Counter(sizes), 30)
        assert Counter(x for p, n in packed for x in p for _ in range(n)) == Counter(sizes) and all(sum(p) <= 30 for p, _ in packed)
        assert sum(n for _, n in packed) == fewest(sizes, 30)


# --- language ID


def test_language_id_held_out(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    out = li.language_id(docs, sample=300).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_sample_takes_distinct_texts(spark, monkeypatch):
    texts = [f"this is text number {'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(100)]
    rows = [(k, x, "en", "a") for k, x in enumerate(texts)]
    rows += [(100 + k, texts[0], "en", "a") for k in range(300)]
    taken = []
    monkeypatch.setattr(li, "train", lambda sample, idf: taken.append(sample))
    li.fit(frame(spark, rows), sample=20)
    assert len(taken[0]) == taken[0]["text"].nunique() == 20


def test_language_id_edges(spark):
    out = [(r.doc_id, r.lang_pred) for r in li.language_id(frame(spark)).collect()]
    assert len(out) == len(EDGES) and {i for i, p in out if p == "und"} == {1, 2, 3, 11}
    assert {r.lang_pred for r in li.language_id(frame(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert li.language_id(frame(spark, [])).count() == 0


# --- quality classifier


def test_quality_classifier(spark):
    rng = random.Random(4)
    common, bad, junk = [f"c{i}" for i in range(400)], ["awful", "rotten"], ["zz%%", "qq%%"]
    rows, labels = [], []
    for i in range(900):
        w, grade = [rng.choice(common) for _ in range(60)], i % 3
        w += [rng.choice(junk)] * 6 if grade == 0 else bad if grade == 1 else []
        rows.append((i, " ".join(w), "en", "a"))
        if i < 600:
            labels.append((i, int(grade > 0), int(grade == 1)))
    out = qc.quality_classifier(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).filter("doc_id >= 600").collect()
    assert sum(r.kept == (r.doc_id % 3 == 2) for r in out) / len(out) > 0.95
    mean = lambda g: np.mean([r.expected_grade for r in out if r.doc_id % 3 == g])
    assert mean(0) < mean(1) < mean(2)


def test_quality_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id in (1, 2, 3), r.kept) for r in qc.quality_classifier(frame(spark), none).collect()} == {(True, False), (False, True)}
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (6, 1, 1), (7, None, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    assert qc.quality_classifier(frame(spark), labels).count() == len(EDGES)
    assert qc.quality_classifier(frame(spark, []), labels).count() == 0


# --- HTML


def test_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in he.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", article))
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)


PAGE = """<body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies. Accept?</div><div class="content"><h1>Title</h1>
<p>A first paragraph with enough words to be read &amp; kept.</p><ul><li>an item of the article</li></ul><div class="comments"><p>Great post, I liked it very much!</p></div></div>
<aside><p>Related: another story of the day.</p></aside><form><label>Name</label><button>Send</button></form><script>var x = "<p>no</p>"</script><footer>&copy; us</footer>"""


def test_html_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, PAGE), (3, None, PAGE), (4, "u", "<p>never closed " + "<b>word</b> " * 5000), (5, "u", "<nav>menu</nav>"), (6, "u", "<<<>>> <p")]
    out = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), he.PRIOR).orderBy("page_id").collect()
    assert len(out) == len(rows) and [r.text for r in out if r.page_id in (1, 2, 5)] == ["", "", ""]
    assert {r.text for r in out if r.page_id == 3} == {"Title\nA first paragraph with enough words to be read & kept.\nan item of the article"}
    assert [r.n_chars for r in out if r.page_id == 4] == [len("never closed " + "word " * 5000) - 1]
    assert he.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>Site</title><meta charset=utf-8><link rel=x href=y><script>a()</script><body><article><p>%s</p></article>", ""),
        ("<html><head><title>Site</title><article><p>%s</p></article>", ""),
        ("<head><title>Site</title><style>p {}</style></head><article><p>%s</p></article>", ""),
        ("<article><svg viewBox='0 0 1 1' /><p>%s</p></article>", ""),
        ("<article><svg><title>t</title><path d='M0'/></svg><p>%s</p></article><svg><text>no</text></svg>", ""),
        ("<article><svg/><p>%s</p></article><svg><text>no</text></svg>", ""),
        ("<article><math/><p>%s</p><math /></article>", ""),
        ("<article><p>%s</p><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>no</annotation></math> holds, the sentence goes on.</p></article>", "\nWhere x=2 holds, the sentence goes on."),
        ("<article><iframe src='a'/><p>%s</p></article>", ""),
        ("<article><canvas><p>%s</p></article>", ""),
        ("<article><video-note><p>%s</p></video-note></article>", ""),
        ("<article><p>%s</p></article><script>var x = '<p>no</p>'", ""),
        ("<article><p>%s</p></article><!-- <p>no</p>", ""),
        ("<article><p>%s</p></article><textarea><p>no</p>", ""),
    ],
)
def test_html_elements_without_end_tags(page, text):
    words = "A first paragraph with enough words to be read and kept."
    assert he.main_text(page % words, he.PRIOR) == words + text


ONE, TWO = "A first paragraph with enough words to be read and kept.", "The second paragraph goes on with more of the story, and ends here."


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single has-sidebar'><article><p>{0}</p><p>{1}</p></article></body>",
        "<body class='sidebar'><article><p>{0}</p><p>{1}</p></article></body>",
        "<body><div class='page no-sidebar share-enabled'><p>{0}</p><p>{1}</p></div></body>",
        "<div class='sidebar'><div><main><p>{0}</p><p>{1}</p></main></div></div><div class='site-sidebar'><p>Another story of the day, read it now.</p></div>",
        "<article><p>{0}</p><svg width='1'/><p>{1}</p></article>",
        "<article><p>{0}</p><p>{1}</p><section><h2>3 Comments</h2><p>I liked this very much, thank you for it.</p><p>So did I, my friend.</p></section></article>",
        "<article><p>{0}</p><p>Sponsored: buy one, get one free today at our shop.</p><p>{1}</p></article>",
    ],
)
def test_html_names_comments_and_adverts(page):
    assert he.main_text(page.format(ONE, TWO), he.PRIOR) == f"{ONE}\n{TWO}"


@pytest.mark.parametrize(
    "page",
    ['<a b="' * 8000, '<a b="' * 8001 + ">x", "<svg>" * 20000 + "<p>x</p>", "<div>" * 8000 + "<p>A word here.</p></div>" * 8000, ("<b>" + "<p>w w</p>") * 4000, '<div><p class="x>some words here <b>and there</p><li>' * 100_000],
    ids=["quotes", "odd-quotes", "open-elements", "deep", "open-inline", "5-MB"],
)
def test_html_broken_pages_take_seconds(page):
    start = time.time()
    he.main_text(page, he.PRIOR)
    assert time.time() - start < 20


def test_html_classifier_sees_nothing_of_the_containers(spark, sf_dir):
    """The same block in an article and in a menu has the same features, and the fitted weights still tell content."""
    x, y = he.blocks(f"<article><p>{ONE}</p></article>"), he.blocks(f"<div class='menu'><p>{ONE}</p></div>")
    assert (he.features(x) == he.features(y)).all() and x[0].evidence() != y[0].evidence()
    w = dict(zip(he.FEATURES, he.fit(table(spark, sf_dir, "pages"))))
    assert w["link_share"] < 0 and w["paragraph"] > 0


def test_minimum_cut_is_least():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(1, 8)
        a, b = np.array([rng.random() for _ in range(n)]), np.array([rng.random() for _ in range(n)])
        edges = [(i, j, rng.random() / 2) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep: sum(b[i] if keep[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if keep[i] != keep[j])
        least = min(cost([(m >> i) & 1 for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(he.minimum_cut(a, b, edges)), least, abs_tol=1e-6)


# --- chat formatting


def test_preference_formatting_matches_sql(spark, sf_dir):
    compare.same_rows(spark, sf_dir, pr.op6_preference_formatting, SQL["op6_preference_formatting"])


def test_preference_edges(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string"
    a = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "yo", ""), (2, 0, None, None, ""), (3, 0, "user", "x", ""), (3, 0, "user", "x", "")], schema)
    b = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "no", ""), (1, 2, "user", "?", ""), (2, 0, "", "", ""), (4, None, "user", "z", "")], schema)
    out = {r.conv_id: r for r in pr.format_preferences(a, b, "conv_id").collect()}
    assert out[1].n_prefix == 1 and out[1].prompt == "<|start|>user\nhi<|end|>\n"
    for side, text in (("chosen", "yo"), ("rejected", "no")):
        done, mask = out[1][f"{side}_completion"], out[1][f"{side}_mask"]
        assert [done[m.start : m.end] for m in mask] == [text + "<|end|>\n"]
    assert out[2].n_prefix == 1 and out[2].chosen_completion == out[2].rejected_completion == ""
    assert out[3].n_prefix == 0 and out[3].chosen_completion.count("x") == 2 and out[4].chosen_completion == ""
    assert pr.format_preferences(a.limit(0), b.limit(0), "conv_id").count() == 0


# --- SentencePiece


def test_sentencepiece_matches_the_library(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sl.default_model())
    docs = documents(spark, sf_dir).limit(60).unionByName(frame(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    out = sl.decode(sl.encode(docs, unigram=False)).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("source_text")).distinct(), "doc_id")
    for r in out.collect():
        if r.doc_id > max(i for i, *_ in EDGES):
            assert r.ids == sp.encode(r.source_text) and r.text == r.source_text
    for r in sl.decode(sl.encode(frame(spark), unigram=False)).collect():
        text = {i: t or "" for i, t, _, _ in EDGES}[r.doc_id]
        assert r.ids == sp.encode(text) and r.text == text


def best_path(unit, known, longest=16):
    """Plain Viterbi over all substrings; of equal scores the longer last piece."""
    table = [(0.0, 0)]
    for end in range(1, len(unit) + 1):
        steps = ((n, known[unit[end - n : end]][1] if unit[end - n : end] in known else -1e4) for n in range(1, min(longest, end) + 1) if n == 1 or unit[end - n : end] in known)
        table.append(max((table[end - n][0] + score, n) for n, score in steps))
    out, end = [], len(unit)
    while end:
        out.append(unit[end - table[end][1] : end])
        end -= table[end][1]
    return out[::-1]


def test_sentencepiece_query_is_viterbi_and_round_trips(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(40).unionByName(frame(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    pieces = sl.piece_table(spark, sl.default_model())
    known = {r.piece: (r.id, r.score) for r in pieces.filter("NOT is_byte").collect()}
    raw = {r["hex"].upper(): r.id for r in pieces.filter("is_byte").collect()}
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text or "")
    for r in sl.decode(sl.encode(docs)).collect():
        assert r.text in texts[r.doc_id]
        marked = "▁" + r.text.replace(" ", "▁") if r.text else ""
        parts = [x for unit in re.findall("\n|▁*[^▁\n]+|▁+", marked) for x in best_path(unit, known)]
        assert r.ids == [i for x in parts for i in ([known[x][0]] if x in known else [raw[f"{b:02X}"] for b in x.encode()])]
    assert sl.encode(frame(spark, [])).count() == 0


def test_viterbi(spark):
    scores = {"a": -1.0, "b": -1.2, "c": -3.0, "ab": -1.5, "bc": -2.5, "abc": -4.1, "▁": -0.5, "▁a": -1.1}
    pieces = spark.createDataFrame([(p, i, s, False, "") for i, (p, s) in enumerate(scores.items())], "piece string, id int, score double, is_byte boolean, hex string")
    names = list(scores)

    def best(unit):
        table = [(0.0, [])]
        for end in range(1, len(unit) + 1):
            table.append(max((table[k][0] + scores[unit[k:end]], table[k][1] + [unit[k:end]]) for k in range(end) if unit[k:end] in scores))
        return table[-1][1]

    found = ["▁abc", "▁ab", "▁", "abcab", "cba"]
    out = sl.encode_units(spark.createDataFrame([(x,) for x in found], "unit string"), pieces, True).collect()
    assert {r.unit: [names[i] for i in r.ids] for r in out} == {x: best(x) for x in found}


def test_long_units_agree_with_the_folds(spark):
    pieces = sl.piece_table(spark, sl.default_model()).filter("NOT is_byte")
    known = {r.piece: (r.id, r.score) for r in pieces.collect()}
    rng = random.Random(4)
    units = ["▁internationalization", "▁antidisestablishmentarianism", "aaaaaaa", "▁naïveté", *("".join(rng.choice("etaoinshrdlu漢é") for _ in range(sl.LONG + k)) for k in (-1, 0, 1))]
    edges = sl.lattice(spark.createDataFrame([(x,) for x in units], "unit string"), pieces.withColumn("is_byte", F.lit(False)), 16)
    for fold, helper in ((sl.merged, sl.merged_long), (lambda e, n: sl.viterbi(e, n, 16), lambda u, t: sl.viterbi_long(u, t, 16)), (lambda e, n: sl.viterbi(e, n, 16), best_path)):
        for r in edges.select("unit", fold(F.col("edges"), F.length("unit")).alias("s")).collect():
            assert [r.unit[x.start - 1 : x.start - 1 + x.size] for x in r.s] == helper(r.unit, known)


# --- LM scores


def lm_brute(texts):
    w = {i: t.lower().split() for i, t in texts.items()}
    ones = Counter(x for v in w.values() for x in v)
    twos = Counter(p for v in w.values() for p in zip(v, v[1:]))
    total = sum(ones.values())

    def score(v):
        out = 0.0
        for i, x in enumerate(v):
            alone = math.log((ones[x] if ones[x] > 1 else 1) / total)
            pair = twos[v[i - 1], x] if i else 0
            out += alone if i == 0 else math.log(pair / ones[v[i - 1]]) if pair > 1 else math.log(0.4) + alone
        return out

    return {i: (len(v), score(v) if v else None) for i, v in w.items()}


def test_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = lm_brute({r.doc_id: r.text or "" for r in docs.collect()})
    for r in lm.score(docs, least=2, order=2).collect():
        assert r.n_words == want[r.doc_id][0] and math.isclose(r.log_score, want[r.doc_id][1], abs_tol=1e-4)


def test_lm_scoring_edges(spark):
    rows = EDGES[:5] + EDGES[6:]
    want = lm_brute({i: t or "" for i, t, _, _ in rows})
    for r in lm.score(frame(spark, rows), least=2, order=2).collect():
        n, score = want[r.doc_id]
        assert r.n_words == n and (r.log_score is None) == (n == 0) and (n == 0 or math.isclose(r.log_score, score, abs_tol=1e-3))
    assert lm.score(frame(spark)).count() == len(EDGES) and lm.score(frame(spark, [])).count() == 0


def backoff_brute(texts, least, order):
    w = {i: t.lower().split() for i, t in texts.items()}
    counts = Counter(tuple(v[k : k + n]) for v in w.values() for n in range(1, order + 1) for k in range(len(v) - n + 1))
    total = sum(map(len, w.values()))

    def ln(gram):
        if len(gram) == 1:
            return math.log((counts[gram] if counts[gram] >= least else 1) / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= least else math.log(0.4) + ln(gram[1:])

    return {i: (len(v), sum(ln(tuple(v[max(0, k - order + 1) : k + 1])) for k in range(len(v))) if v else None) for i, v in w.items()}


@pytest.mark.parametrize("least, order", ((1, 3), (2, 3), (1, 1), (3, 4), (1, 2), (1, 4)))
def test_lm_scoring_orders(spark, least, order):
    rng = random.Random(order)
    texts = {i: " ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))) for i in range(30)}
    want = backoff_brute(texts, least, order)
    for r in lm.score(frame(spark, [(i, t, "en", "a") for i, t in texts.items()]), least=least, order=order).collect():
        n, score = want[r.doc_id]
        assert r.n_words == n and (n == 0 or math.isclose(r.log_score, score, abs_tol=1e-4))


@pytest.mark.parametrize("hot", (0, 5, 100_000))
def test_lm_scoring_hot_contexts(spark, monkeypatch, hot):
    """One pair of words holds a third of all; its counts are taken apart, or in the buckets, to the same scores."""
    rng, used = random.Random(hot), []
    monkeypatch.setattr(lm, "HOT", hot)
    found = lm._hot_keys
    monkeypatch.setattr(lm, "_hot_keys", lambda *x: used.append(found(*x)) or used[-1])
    texts = {i: " ".join("of the " + rng.choice("abcdefghij") for _ in range(rng.choice([0, 1, 5, 30]))) + rng.choice(["", " of", " of the", " z"]) for i in range(120)}
    rows = [(i, t, "en", "a") for i, t in texts.items()]
    want = backoff_brute(texts, 1, 3)
    for r in lm.score(frame(spark, rows)).collect():
        n, score = want[r.doc_id]
        assert r.n_words == n and (n == 0 or math.isclose(r.log_score, score, abs_tol=1e-4))
    assert (len(used[0]) > 0) == (hot > 0)
    # rows that share a doc_id are one document, rows without one count
    double = lm.score(frame(spark, rows + rows[:40] + [(None, t, "en", "a") for t in list(texts.values())[40:]])).collect()
    assert len(double) == 240 and all(r.n_words == (0 if r.doc_id is None else want[r.doc_id][0] * (1 + (r.doc_id < 40))) for r in double)
    for r in double:
        if r.doc_id is not None and want[r.doc_id][0]:
            n, score = want[r.doc_id]
            assert math.isclose(r.log_score, score * (1 + (r.doc_id < 40)), abs_tol=1e-4)


def test_lm_scoring_query_keeps_all_counts(spark, sf_dir):
    want = backoff_brute({r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}, 1, 3)
    for r in lm.op2_lm_scoring(spark, sf_dir).collect():
        assert r.n_words == want[r.doc_id][0] and math.isclose(r.log_score, want[r.doc_id][1], abs_tol=1e-4)


# --- pipeline


def test_pipeline_near_duplicates(spark):
    """Five words and 0.8: pairs that 4 words and 0.85 keep apart are one group here."""
    import corpus_pipeline as cp

    rng, rows = random.Random(7), []
    for family in range(20):
        words = [f"f{family}w{k}" for k in range(60)]
        for _ in range(3):
            w = list(words)
            w[rng.randrange(10, 50)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(w[: rng.randint(56, 60)]), "en", "a"))
    kept = {r.doc_id for r in cp.keep_one_of_each_group(spark, frame(spark, rows), "").collect()}
    stays = lambda n, percent: {i for i, (_, c) in brute_components([x[:2] for x in rows], n, percent).items() if i == c}
    assert kept == stays(5, 80) and kept != stays(4, 85)


def test_pipeline_judges_rows(spark):
    """Null, repeated and shared doc_ids: each row has its own verdict, and one of each group stays."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    good = [" ".join(f"t{t}w{rng.randint(0, 10**6)}" for _ in range(100)) for t in range(8)]
    rows = [(None, good[0], "en", "a"), (1, good[1], "en", "a"), (1, "too short", "en", "a"), (2, good[2], "en", "a"), (2, good[2], "en", "a"), (None, "short", "en", "a")]
    found = cp.keep_good_quality(spark, frame(spark, rows), "")
    assert sorted(found.select("doc_id", "text").collect(), key=str) == sorted([x[:2] for k, x in enumerate(rows) if k not in (2, 5)], key=str)
    rows = [(None, good[0], "en", "a"), (None, good[0], "en", "a"), (None, good[1], "en", "a"), (9, good[1], "en", "a"), (5, good[1], "en", "a"), (5, good[1], "en", "a"),
            (3, good[2], "en", "a"), (3, good[3], "en", "a"), (4, good[3], "en", "a"), (4, good[4], "en", "a")]
    found = cp.keep_one_of_each_group(spark, frame(spark, rows), "")
    assert sorted(found.select("doc_id", "text").collect(), key=str) == sorted([(None, good[0]), (5, good[1]), (3, good[2]), (3, good[3]), (4, good[4])], key=str)


def test_pipeline_keeps_repeats_without_words(spark):
    import corpus_pipeline as cp

    rows = [(1, None, "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (2, "", "en", "a"), (None, " \n", "en", "a"), (None, " \n", "en", "a"), (3, "a b", "en", "a"), (3, "a b", "en", "a")]
    found = cp.keep_one_of_each_group(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(found, key=str) == sorted([x[:2] for x in rows[:-1]], key=str)


def test_pipeline_edges_and_clashing_names(spark, sf_dir):
    """Null, empty, blank, repeated and long texts, no rows, and columns named as the stages name theirs."""
    import corpus_pipeline as cp

    names = ("score", "lang_pred", "_text", "_row", "row", "kept", "component_id", "n_words", "bucket", "least")
    clashing = lambda df: df.withColumns({n: F.lit(n) for n in names})
    for docs in (clashing(frame(spark)), clashing(frame(spark, []))):
        before = Counter(map(str, docs.collect()))
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and not Counter(map(str, out.collect())) - before
        assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    kept = cp.keep_one_of_each_group(spark, frame(spark), "").collect()
    assert len(kept) == len({(x[1] or "").lower().split() and " ".join((x[1] or "").lower().split()) or x[0] for x in EDGES})


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs, kept = documents(spark, sf_dir), None
    columns = set(docs.columns)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert set(out.columns) == columns
        if stage is cp.keep_one_of_each_group:
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            kept = {i for i, (_, c) in want.items() if i == c}
            assert {r.doc_id for r in out.collect()} == kept
        docs = cp.materialize(out, "test-stage")
    packed = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == kept
    check_packing(packed, {r.doc_id: r.text for r in docs.collect()})

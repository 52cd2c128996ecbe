"""Markdown trees, scopes of negation and relations between sentences against plain readings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from promptlake.functions import relations, rules
from promptlake.operators import discourse as di
from promptlake.operators import markdown as md
from promptlake.storage import written

TEXT = """intro
# One

para a
# not a heading, the paragraph goes on
***
title
-----

## One.one
- a
- b
  - deeper
1. c
> q1
> q2
### Deep
|x|y|
|-|-|
|1|2|
after the table

```py
# code
```
---
## Empty
# Two
## References
~~~
not closed
| no table |"""


def tree(spark, *texts):
    return md.nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"))


def test_nodes(spark):
    found = sorted(tree(spark, TEXT).collect(), key=lambda r: r.id)
    assert [(r.id, r.parent, r.last, r.kind, r.level, r.content) for r in found] == [
        (0, None, 20, "document", 0, ""), (1, 0, 1, "paragraph", 0, "intro\n# One"), (2, 0, 2, "paragraph", 0, "para a\n# not a heading, the paragraph goes on\n***\ntitle\n-----"),
        (3, 0, 16, "section", 2, "One.one"), (4, 3, 6, "list", 0, "a\nb"), (5, 4, 5, "item", 0, "a"), (6, 4, 6, "item", 0, "b"), (7, 3, 8, "list", 0, "deeper"), (8, 7, 8, "item", 0, "deeper"),
        (9, 3, 10, "list", 0, "c"), (10, 9, 10, "item", 0, "c"), (11, 3, 11, "quote", 0, "q1\nq2"), (12, 3, 12, "subsection", 3, "Deep"), (13, 3, 13, "table", 0, "|x|y|\n|-|-|\n|1|2|"),
        (14, 3, 14, "paragraph", 0, "after the table"), (15, 3, 15, "code", 0, "```py\n# code\n```"), (16, 3, 16, "rule", 0, "---"), (17, 0, 17, "section", 2, "Empty"), (18, 0, 20, "section", 1, "Two"),
        (19, 18, 20, "section", 2, "References"), (20, 19, 20, "code", 0, "~~~\nnot closed\n| no table |"),
    ]
    assert [list(r.path) for r in found][3:9] == [[3], [3, 1], [3, 1, 1], [3, 1, 2], [3, 2], [3, 2, 1]]


def plain_tree(rows):
    """parent to children, from nodes in order."""
    children = {r.id: [] for r in rows}
    for r in rows[1:]:
        children[r.parent].append(r.id)
    return children


@pytest.mark.parametrize("seed", range(3))
def test_intervals_paths_and_pruning(spark, seed):
    """Random texts: intervals and paths agree with parents; pruning with a recursive reading; leaves with a walk."""
    rng = random.Random(seed)
    parts = ["# h", "## h", "### h", "", "", "- a", "  - b", "2) c", "> q", "|a|", "```", "~~~", "---", "text", "#no", "## References", ">", "-"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(30)]
    all_rows = tree(spark, *texts)
    nodes, pruned, flat, kept = (x.collect() for x in (all_rows, md.without_empty_sections(all_rows), md.flat_texts(all_rows), md.without_noise_sections(all_rows)))
    for doc, _ in enumerate(texts):
        rows = sorted((r for r in nodes if r.doc_id == doc), key=lambda r: r.id)
        children = plain_tree(rows)

        def under(i):
            return {i}.union(*map(under, children[i]))

        def stays(i):
            below = [*map(stays, children[i])]
            return any(below) if rows[i].kind in md.SECTIONS else bool(rows[i].content.strip()) or bool(children[i])

        def walk(i):
            return [x for c in children[i] for x in walk(c)] if children[i] else [rows[i].content]

        assert all(under(r.id) == set(range(r.id, r.last + 1)) for r in rows)
        assert all([*children[r.parent]].index(r.id) + 1 == r.path[-1] and [*rows[r.parent].path] == [*r.path[:-1]] for r in rows[1:])
        assert {r.id for r in pruned if r.doc_id == doc} == {r.id for r in rows if r.id == 0 or stays(r.id)}
        assert [r.text for r in flat if r.doc_id == doc] == ["\n".join(walk(0))]
        noise, want = False, set()
        for r in rows:
            noise = r.content == "References" if r.kind in ("section", "subsection") else noise
            want |= set() if noise else {r.id}
        assert {r.id for r in kept if r.doc_id == doc} == want


def test_no_text(spark):
    assert [(r.kind, r.last) for r in tree(spark, None, "", " \n\t").collect()] == [("document", 0)] * 3


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\n\nb")
    (tmp_path / "b.txt").write_bytes("é".encode() + b"\xff")
    found = {r.doc_id.rsplit("/", 1)[1]: r.t for r in md.read_texts(spark, str(tmp_path)).collect()}
    assert found == {"a.md": "# A\n\nb", "b.txt": "é�"}


# --- scopes

LANGS = [
    (1, "en", "I do not like it, and she cannot stay; nobody isn't here. It's not impossible but never without cost"), (2, "fr", "Je ne veux pas rester, et il n'a plus rien. Ce n'est pas impossible mais ne le fais point"),
    (3, "en", ""), (4, "en", None), (5, "fr", "not pas"), (6, "en", "no, no. no! and or"), (7, "fr", "Il ne mange jamais; nulle part ailleurs, guère plus"), (8, "en", "Not unhappy. NEVER disagree, don't"), (9, "en", "word " * 50 + "not " * 20),
]


def plain_scopes(doc, lang, text):
    edge = lambda p: re.compile(rf"\b({rules.spaced(p)})\b", re.I)
    stops = [(m.start(), m.end()) for m in re.finditer(rf"[.!?;,]|\b({rules.spaced(relations.SCOPE_ENDS[lang])})\b", text, re.I)]
    for cues in (rules.NEGATION_CUES_EN, rules.NEGATION_CONTRACTED_EN, *[relations.NEGATION_CUES_FR] * (lang == "fr")):
        for m in edge(cues).finditer(text):
            begin = max((e for _, e in stops if e <= m.start()), default=0)
            end = min((s for s, _ in stops if s >= m.end()), default=len(text))
            scope = text[begin:end].strip()
            yield doc, m[0], m.start(), m.end(), begin, end, scope, bool(edge(relations.DOUBLE_NEGATION[lang]).search(scope)), lang == "fr" and bool(re.search(relations.CONCORD_FR, scope, re.I))


def test_negation_scopes(spark):
    found = di.negation_scopes(spark.createDataFrame(LANGS, "doc_id long, lang string, t string")).collect()
    assert sorted(map(tuple, found)) == sorted(x for row in LANGS if row[2] for x in plain_scopes(*row))


def test_scopes_of_the_query(spark, sf_dir):
    from promptlake.plans import documents

    texts = documents._texts(spark, sf_dir)
    found = di.negation_scopes(texts).collect()
    assert sorted(map(tuple, found)) == sorted(x for r in texts.collect() for x in plain_scopes(r.doc_id, r.lang, r.t))


# --- relations


def plain_relations(doc, text):
    sentences = [s.strip() for s in (text or "").replace("\n", " ").split(".") if s.strip()]
    for i, s in enumerate(sentences):
        for name, patterns in relations.SENTENCE_RELATIONS.items():
            m = next((m for p in patterns if (m := re.search(rf"\b{p}", s, re.I))), None)
            if m:
                target = i + 1 if name in relations.FORWARD and i + 1 < len(sentences) else i - 1 if name in relations.BACKWARD and i else None
                yield doc, i, name, m[0], target


RELATED = [
    (1, None, "He left because of rain. Therefore we stayed. If so, then go. In summary it rained. But before that\nit did not. Ultimately nothing"), (2, None, ""), (3, None, None), (4, None, "Because. Because. Thus. Thus. Because"),
    (5, None, "Either a or b. NOT ONLY a but also b. For example c. such as é. as well as. Since when"), (6, None, "..."),
]


def test_relations_and_reach(spark):
    df = spark.createDataFrame([(i, t) for i, _, t in RELATED], "doc_id long, t string")
    found = di.related(df)
    rows = [x for i, _, t in RELATED for x in plain_relations(i, t)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, rows))
    edges = {(d, i, j) for d, i, _, _, j in rows if j is not None}
    assert {(r.doc_id, r.source, r.to) for r in di.edges(found).collect()} == {(d, f"sent_{i}", f"sent_{j}") for d, i, j in edges}
    for r in di.reach(df, found).collect():
        seen, todo = set(), [r.sentence]
        while todo:
            at = todo.pop()
            new = {j for d, i, j in edges if d == r.doc_id and i == at} - seen
            seen |= new
            todo += new
        assert (r.first, r.last, r.on_cycle) == (min(seen | {r.sentence}), max(seen | {r.sentence}), r.sentence in seen)


def test_markers(spark):
    text = "However, e.g.x as a result we go, parce que c'est ainsi, afin de voir"
    df = spark.createDataFrame([("en", text), ("fr", text), ("en", None)], "lang string, t string")
    found = [[tuple(x) for x in r[0] or ()] for r in df.select(di.markers(df["t"], df["lang"])).collect()]
    for got, lang in zip(found, ("en", "fr")):
        assert got == [(name, m[0]) for name, p in relations.MARKERS[lang].items() if (m := re.search(rf"\b({rules.spaced(p)})\b", text, re.I))]
    assert found[2] == []


def test_each_relation_is_found_in_any_case(spark):
    """Every way to mark a relation is found, however it is written; where no word of a pattern is said, the pattern is not searched for."""
    said = [re.sub(r"\\b|[()?]", "", re.sub(r"\.[*+]", "x", w.replace(r"\s+", " ").replace(r"\.", "."))) for ps in relations.SENTENCE_RELATIONS.values() for p in ps for w in ways(p)]
    texts = [f(w) for w in said if "." not in w for f in (str, str.upper, lambda x: f"\u201c{x}\u201d, {x} x", lambda x: x.replace("s", "\u017f").replace("i", "\u0131").replace("k", "\u212a"), lambda x: x.replace("i", "\u0130"), lambda x: f"a{x}a _{x}_")]
    table = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"), "said")
    found = {(r.doc_id, r.relation): r.marker for r in di.related(table).collect()}
    plain = lambda p: F.nullif(F.regexp_extract("t", rf"(?iU)\b{p}", 0), F.lit(""))
    whole = table.select("doc_id", *[F.coalesce(*map(plain, ps)).alias(x) for x, ps in relations.SENTENCE_RELATIONS.items()]).collect()
    want = {(r.doc_id, x): r[x] for r in whole for x in relations.SENTENCE_RELATIONS if r[x] is not None}
    assert found == want and len({i for i, _ in want}) > 4 * len(texts) // 6
    few = di.related(table, relations.FORWARD + relations.BACKWARD).filter("target IS NOT NULL")
    assert few.count() == di.related(table).filter("target IS NOT NULL").count()


def ways(pattern):
    group = re.match(r"\(([^()]*)\)(.*)", pattern)
    return [x + group[2] for x in group[1].split("|")] if group else [pattern]

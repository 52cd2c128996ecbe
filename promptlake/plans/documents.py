"""Queries of Markdown trees, scopes of negation and relations between sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, relations, rules
from ..operators import discourse as di
from ..operators import markdown as md
from ..sources import tables as t
from .registry import query

# --- Markdown


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and t: each whole text with its lines marked up in turn as headings, lists, quotes, tables, code and paragraphs."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def marked(x, i):
        put = lambda before, after="": F.concat(F.lit(before), x, F.lit(after))
        at = i % 9
        return (
            F.when((i == 9) & (F.col("doc_id") % 3 == 0), F.lit("## References ")).when(at == 0, put("# ")).when(at == 1, put("", "\n")).when(at == 2, put("## ")).when(at == 3, put("- "))
            .when(at == 4, put("  - ", "\n2. a\n- b")).when(at == 5, put("> ")).when(at == 6, put("|", "|")).when(at == 7, put("```py\n", "\n```")).otherwise(put("---\n### ", "\n "))
        )

    return t.read(spark, d, "documents").select("doc_id", F.array_join(F.transform(lines, marked), "\n").alias("t"))


_MARKED = """SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i = 10 AND doc_id % 3 = 0 THEN '## References ' ELSE CASE (i - 1) % 9
WHEN 0 THEN '# ' || x WHEN 1 THEN x || chr(10) WHEN 2 THEN '## ' || x WHEN 3 THEN '- ' || x WHEN 4 THEN '  - ' || x || chr(10) || '2. a' || chr(10) || '- b' WHEN 5 THEN '> ' || x WHEN 6 THEN '|' || x || '|'
WHEN 7 THEN '```py' || chr(10) || x || chr(10) || '```' ELSE '---' || chr(10) || '### ' || x || chr(10) || ' ' END END), chr(10)) AS t FROM documents"""

#: The state machine a line at a time: what each line belongs to, then nodes, parents and intervals by windows.
_TREE = rf"""WITH RECURSIVE marked AS ({_MARKED}),
lines AS (SELECT doc_id, i, line, regexp_matches(trim(line), '^(```|~~~)') AS fence, regexp_matches(line, '^(#{{1,6}})\s+(.+)$') AS heading, regexp_matches(line, '^[-*_]{{3,}}\s*$') AS rule,
  regexp_matches(line, '^>\s*(.+)$') AS quote, regexp_matches(line, '^\|.+\|$') AS cells, regexp_matches(line, '^(\s*)[-*+]\s+(.+)$') AS bullet, regexp_matches(line, '^(\s*)\d+[.)]\s+(.+)$') AS number,
  trim(line) = '' AS blank, length(regexp_extract(line, '^(\s*)', 1)) AS depth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM marked) x),
states AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS mode, CAST(0 AS BIGINT) AS indent, CAST(0 AS BIGINT) AS block, '' AS kind FROM marked
  UNION ALL
  SELECT doc_id, i, CASE WHEN goes_on AND mode = 'code' AND fence THEN '' WHEN goes_on THEN mode WHEN kind IN ('section', 'subsection', 'rule') THEN '' ELSE kind END,
    CASE WHEN goes_on THEN indent ELSE depth END, block + CAST(NOT goes_on AND kind <> '' AS BIGINT), CASE WHEN goes_on THEN mode ELSE kind END
  FROM (SELECT l.*, s.mode, s.indent, s.block,
      CASE s.mode WHEN 'code' THEN true WHEN 'paragraph' THEN NOT l.blank WHEN 'quote' THEN l.quote WHEN 'table' THEN l.cells WHEN 'list' THEN (l.bullet OR l.number) AND l.depth = s.indent
        WHEN 'numbers' THEN l.bullet OR l.number ELSE false END AS goes_on,
      CASE WHEN l.fence THEN 'code' WHEN l.heading AND length(regexp_extract(l.line, '^(#+)', 1)) <= 2 THEN 'section' WHEN l.heading THEN 'subsection' WHEN l.rule THEN 'rule' WHEN l.quote THEN 'quote' WHEN l.cells THEN 'table'
        WHEN l.bullet THEN 'list' WHEN l.number THEN 'numbers' WHEN l.blank THEN '' ELSE 'paragraph' END AS kind
    FROM states s JOIN lines l ON l.doc_id = s.doc_id AND l.i = s.i + 1) x),
shown AS (SELECT s.doc_id, s.i, s.block, s.kind, CASE WHEN s.kind IN ('section', 'subsection') THEN length(regexp_extract(l.line, '^(#+)', 1)) ELSE 0 END AS level,
  CASE WHEN s.kind IN ('section', 'subsection') THEN trim(regexp_extract(l.line, '^#+\s+(.+)$', 1)) WHEN s.kind = 'rule' THEN trim(l.line) WHEN s.kind = 'quote' THEN regexp_extract(l.line, '^>\s*(.+)$', 1)
    WHEN s.kind IN ('list', 'numbers') THEN regexp_extract(l.line, '^\s*([-*+]|\d+[.)])\s+(.+)$', 2) ELSE l.line END AS content
  FROM states s JOIN lines l ON l.doc_id = s.doc_id AND l.i = s.i WHERE s.kind <> ''),
parts AS (SELECT doc_id, block, min(i) AS i, CASE any_value(kind) WHEN 'numbers' THEN 'list' ELSE any_value(kind) END AS kind, max(level) AS level, string_agg(content, chr(10) ORDER BY i) AS content FROM shown GROUP BY 1, 2
  UNION ALL SELECT doc_id, block, i, 'item', 0, content FROM shown WHERE kind IN ('list', 'numbers')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, kind = 'item', i) AS id, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, block) AS size FROM parts),
placed AS (SELECT *, max(CASE WHEN level = 1 THEN id END) OVER before AS one, max(CASE WHEN level = 2 THEN id END) OVER before AS two, min(CASE WHEN level = 1 THEN id END) OVER behind AS next_one,
  min(CASE WHEN level IN (1, 2) THEN id END) OVER behind AS next_two, min(id) OVER (PARTITION BY doc_id, block) AS head FROM numbered
  WINDOW before AS (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), behind AS (PARTITION BY doc_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
tree AS (SELECT doc_id, CAST(id AS INT) AS id, CAST(CASE WHEN kind = 'item' THEN head WHEN level = 1 THEN 0 WHEN level = 2 THEN coalesce(one, 0) WHEN coalesce(two, 0) > coalesce(one, 0) THEN two ELSE coalesce(one, 0) END AS INT) AS parent,
    CAST(CASE WHEN level = 1 THEN coalesce(next_one - 1, n) WHEN level = 2 THEN coalesce(next_two - 1, n) WHEN kind = 'list' THEN id + size - 1 ELSE id END AS INT) AS last, kind, CAST(level AS INT) AS level, content FROM placed
  UNION ALL SELECT m.doc_id, 0, NULL, CAST((SELECT count(*) FROM parts p WHERE p.doc_id = m.doc_id) AS INT), 'document', 0, '' FROM marked m)"""


@query(f"{_TREE} SELECT * FROM tree")
def d15_markdown_nodes(spark: SparkSession, d: str) -> DataFrame:
    return md.nodes(marked_documents(spark, d)).drop("path")


@query(f"{_TREE} SELECT doc_id, string_agg(content, chr(10) ORDER BY id) AS text, count(*) AS leaves FROM tree WHERE id = last GROUP BY 1")
def d16_flat_texts(spark: SparkSession, d: str) -> DataFrame:
    return md.flat_texts(md.nodes(marked_documents(spark, d)))


_FULL = "(b.kind NOT IN ('document', 'section', 'subsection') AND (trim(b.content) <> '' OR b.last > b.id))"


@query(f"""{_TREE} SELECT doc_id, id, kind FROM tree a WHERE kind = 'document' OR (kind IN ('section', 'subsection') AND EXISTS (SELECT 1 FROM tree b WHERE b.doc_id = a.doc_id AND b.id > a.id AND b.id <= a.last AND {_FULL}))
OR (kind NOT IN ('section', 'subsection') AND (trim(content) <> '' OR last > id))""")
def g05_sections_with_content(spark: SparkSession, d: str) -> DataFrame:
    return md.without_empty_sections(md.nodes(marked_documents(spark, d))).select("doc_id", "id", "kind")


@query(f"""{_TREE}, under AS (SELECT *, max(CASE WHEN kind IN ('section', 'subsection') THEN id END) OVER (PARTITION BY doc_id ORDER BY id) AS heading FROM tree)
SELECT u.doc_id, u.id FROM under u LEFT JOIN tree h ON h.doc_id = u.doc_id AND h.id = u.heading WHERE u.heading IS NULL OR lower(trim(h.content)) NOT IN ({', '.join(f"'{x}'" for x in lexicon.NOISE_HEADINGS)})""")
def d21_without_noise_sections(spark: SparkSession, d: str) -> DataFrame:
    return md.without_noise_sections(md.nodes(marked_documents(spark, d))).select("doc_id", "id")


# --- scopes, markers, relations


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang (fr or en) and t: each whole text with one phrase appended."""
    lang = F.when(F.col("lang") == "fr", "fr").otherwise("en")
    return t.phrased_documents(spark, d).join(t.read(spark, d, "documents").select("doc_id", lang.alias("lang")), "doc_id")


_TEXTS = f"SELECT p.doc_id, CASE WHEN d.lang = 'fr' THEN 'fr' ELSE 'en' END AS lang, {rules.sql_mark('p.t')} AS m, p.t FROM ({t.PHRASED_SQL}) p JOIN documents d ON p.doc_id = d.doc_id"
_PLAIN = r"regexp_replace({}, '_([^\x00-\x7F])_', '\1', 'g')"


@query()
def e10_negation_scopes(spark: SparkSession, d: str) -> DataFrame:
    return di.negation_scopes(_texts(spark, d))


def _sql_ends(lang: str) -> str:
    return rf"(?i)[.!?;,]|\b({rules.spaced(relations.SCOPE_ENDS[lang])})\b"


def _sql_cues(text: str, phrases: str) -> str:
    return f"len(regexp_extract_all({text}, '{rules.sql_pattern(phrases)}'))"


_CONCORD = rules.sql_pattern(relations.CONCORD_FR).replace(r"\b(", "(", 1).removesuffix(r"\b")


@query(rf"""WITH clauses AS (SELECT doc_id, lang, unnest(CASE lang WHEN 'fr' THEN regexp_split_to_array(m, '{_sql_ends('fr')}') ELSE regexp_split_to_array(m, '{_sql_ends('en')}') END) AS c FROM ({_TEXTS}) x),
counted AS (SELECT doc_id, {_sql_cues('c', rules.NEGATION_CUES_EN)} + {_sql_cues('c', rules.NEGATION_CONTRACTED_EN)} + CASE lang WHEN 'fr' THEN {_sql_cues('c', relations.NEGATION_CUES_FR)} ELSE 0 END AS n,
  length({_PLAIN.format('c')}) AS width, regexp_matches(c, CASE lang WHEN 'fr' THEN '{rules.sql_pattern(relations.DOUBLE_NEGATION['fr'])}' ELSE '{rules.sql_pattern(relations.DOUBLE_NEGATION['en'])}' END) AS double,
  lang = 'fr' AND regexp_matches(c, '{_CONCORD}') AS concord FROM clauses)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS cues, CAST(sum(n * width) AS BIGINT) AS characters, CAST(sum(CASE WHEN double THEN n ELSE 0 END) AS BIGINT) AS double, CAST(sum(CASE WHEN concord THEN n ELSE 0 END) AS BIGINT) AS concord
FROM counted GROUP BY 1 HAVING sum(n) > 0""")
def e10_scope_sums(spark: SparkSession, d: str) -> DataFrame:
    """Of each document with a cue: how many, the characters in their scopes, and how many in a double negation or in ne with what completes it."""
    found = di.negation_scopes(_texts(spark, d)).groupBy("doc_id")
    return found.agg(F.count("*").alias("cues"), F.sum(F.col("scope_end") - F.col("scope_start")).alias("characters"), F.count_if("is_double").alias("double"), F.count_if("is_concord").alias("concord"))


_MARKERS = ", ".join(
    f"{{'relation': '{r}', 'marker': " + _PLAIN.format("CASE lang " + " ".join(f"WHEN '{x}' THEN regexp_extract(m, '{rules.sql_pattern(relations.MARKERS[x][r])}', 0)" for x in ("en", "fr")) + " END") + "}" for r in relations.MARKERS["en"]
)


@query(f"SELECT doc_id, x.relation, x.marker FROM (SELECT doc_id, unnest([{_MARKERS}]) AS x FROM ({_TEXTS}) y) z WHERE x.marker <> ''")
def e05_discourse_markers(spark: SparkSession, d: str) -> DataFrame:
    found = _texts(spark, d).select("doc_id", F.explode(di.markers(F.col("t"), F.col("lang"))).alias("x"))
    return found.select("doc_id", "x.relation", "x.marker")


def _sql_relation(name: str, patterns: tuple[str, ...]) -> str:
    hits = ", ".join(rf"nullif(regexp_extract(s, '(?i)\b{p}', 0), '')" for p in patterns)
    return f"{{'relation': '{name}', 'marker': {_PLAIN.format(f'coalesce({hits})')}}}"


_RELATED = rf"""sentences AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS sentence
  FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(m, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM ({_TEXTS}) y) z),
related AS (SELECT doc_id, sentence, x.relation, x.marker, CASE WHEN x.relation IN {relations.FORWARD} AND sentence + 1 < n THEN sentence + 1 WHEN x.relation IN {relations.BACKWARD} AND sentence > 0 THEN sentence - 1 END AS target
  FROM (SELECT doc_id, sentence, n, unnest([{', '.join(_sql_relation(*x) for x in relations.SENTENCE_RELATIONS.items())}]) AS x FROM sentences) w WHERE x.marker IS NOT NULL)"""


@query(f"WITH {_RELATED} SELECT doc_id, CAST(sentence AS INT) AS sentence, relation, marker, CAST(target AS INT) AS target FROM related")
def e14_sentence_relations(spark: SparkSession, d: str) -> DataFrame:
    return di.related(_texts(spark, d))


@query(f"WITH {_RELATED} SELECT doc_id, 'sent_' || sentence AS source, 'sent_' || target AS \"to\", relation FROM related WHERE target IS NOT NULL")
def e15_discourse_edges(spark: SparkSession, d: str) -> DataFrame:
    return di.edges(di.related(_texts(spark, d), relations.FORWARD + relations.BACKWARD))


@query(f"""WITH RECURSIVE {_RELATED}, ways AS (SELECT DISTINCT doc_id, sentence, target FROM related WHERE target IS NOT NULL),
walks AS (SELECT doc_id, sentence AS start, target AS at FROM ways UNION SELECT w.doc_id, w.start, y.target FROM walks w JOIN ways y ON y.doc_id = w.doc_id AND y.sentence = w.at)
SELECT s.doc_id, s.sentence, least(s.sentence, coalesce(min(w.at), s.sentence)) AS first, greatest(s.sentence, coalesce(max(w.at), s.sentence)) AS last, coalesce(bool_or(w.at = s.sentence), false) AS on_cycle
FROM sentences s LEFT JOIN walks w ON w.doc_id = s.doc_id AND w.start = s.sentence GROUP BY s.doc_id, s.sentence""")
def e15_reached_sentences(spark: SparkSession, d: str) -> DataFrame:
    x = _texts(spark, d)
    return di.reach(x, di.related(x, relations.FORWARD + relations.BACKWARD))

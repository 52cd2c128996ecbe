"""Queries of the text operators and measures over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import language as la
from ..operators import learning as le
from ..operators import measures as me
from ..operators import sessions as se
from ..operators import text as tx
from ..sources import tables as t
from .registry import query

P = t.PHRASED_SQL
WS = r"[\s\x0B]+"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents")


def _phrased(spark: SparkSession, d: str) -> DataFrame:
    return t.phrased_documents(spark, d)


def _sql_chain(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, short in steps:
        text = f"regexp_replace({text}, '{pattern}', '{short}', 'g')"
    return text


def _sql_phrases(text: str, *tables) -> str:
    steps = [(rules.sql_pattern(p), s.replace("'", "''")) for table in tables for p, s in table]
    return rules.sql_marked(text, lambda x: _sql_chain(x, steps))


def _sha(column) -> object:
    return F.sha2(column, 256)


@query(f"SELECT page_id, sha256({_sql_chain('html', [('(?is)<style[^>]*>.*?</style>', ''), ('(?is)<script[^>]*>.*?</script>', ''), ('<[^>]+>', ' ')])}) AS stripped FROM pages")
def a11_html_strip(spark: SparkSession, d: str) -> DataFrame:
    steps = [(r"(?is)<style[^>]*>.*?</style>", ""), (r"(?is)<script[^>]*>.*?</script>", ""), (r"<[^>]+>", " ")]
    return t.read(spark, d, "pages").select("page_id", _sha(tx.chain(F.col("html"), steps)).alias("stripped"))


@query(f"SELECT page_id, trim({_sql_chain('html', [('(?is)<style[^>]*>.*?</style>', ''), ('(?is)<script[^>]*>.*?</script>', ''), ('<[^>]+>', ' '), (WS, ' ')])}) AS text FROM pages")
def a11_html_text(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query(f"SELECT doc_id, sha256(trim({_sql_chain('text', [('(?m)^[-*_]{3,}[ ]*$', ''), ('(?m)^(#{1,6})[ ]+', chr(92) + '1 '), (chr(92) + 'n{3,}', chr(10) + chr(10)), ('(?m)[ ]+$', '')])})) AS hash FROM documents")
def g01_structural(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _sha(tx.structural(F.col("text"))).alias("hash"))


@query(f"SELECT doc_id, {_sql_phrases('t', rules.LOGICAL_EN)} AS out FROM ({P}) x")
def g02_logical(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.logical(F.col("t")).alias("out"))


@query(f"SELECT doc_id, {_sql_phrases('t', rules.TEMPORAL_EN)} AS out FROM ({P}) x")
def g03_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.temporal(F.col("t")).alias("out"))


@query(f"SELECT doc_id, {_sql_phrases('t', rules.LOGICAL_EN, rules.TEMPORAL_EN)} AS out FROM ({P}) x")
def g04_logical_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.temporal(tx.logical(F.col("t"))).alias("out"))


@query(f"SELECT doc_id, {_sql_phrases('t', rules.PHRASES_EN)} AS out FROM ({P}) x")
def g06_phrase_shortening(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.shorten(F.col("t")).alias("out"))


@query(f"SELECT doc_id, {_sql_phrases('t', rules.FLUFF_EN)} AS out FROM ({P}) x")
def g07_fluff_removal(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.without_fluff(F.col("t")).alias("out"))


_COURTESY = [("(?i)" + r"\b" + p.replace("'", "''") + ("" if p.endswith("+") or p.endswith(")?") else r"\b"), s) for p, s in rules.POLITE_EN]


@query(f"SELECT doc_id, {rules.sql_marked('t', lambda x: _sql_chain(x, _COURTESY))} AS out FROM ({P}) x")
def g08_courtesy_removal(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.without_courtesy(F.col("t")).alias("out"))


_LEXICAL_STEPS = [(rules.sql_pattern(p), s.replace("'", "''")) for p, s in (*rules.PHRASES_EN, *rules.FLUFF_EN)] + _COURTESY
_LEXICAL = f"trim({_sql_chain(rules.sql_marked('t', lambda x: _sql_chain(x, _LEXICAL_STEPS)), [(' +', ' '), (chr(92) + 's+([.,;:!?])', chr(92) + '1'), (chr(92) + 's{2,}', ' ')])})"


@query(f"SELECT doc_id, {_LEXICAL} AS out FROM ({P}) x")
def g09_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.lexical(F.col("t")).alias("out"))


@query(f"SELECT doc_id, trim({_sql_chain(rules.sql_marked('t', lambda x: _sql_chain(x, [('!{2,}', '!'), (chr(92) + '?{2,}', '?'), (rules.sql_pattern(rules.FILLERS), '')])), [(WS, ' ')])}) AS out FROM ({P}) x")
def g22_light_clean(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.light_clean(F.col("t")).alias("out"))


_SNIFF = r"""CASE WHEN length(trim(x)) = 0 THEN 'txt' WHEN starts_with(trim(x), '<html') THEN 'html' WHEN starts_with(trim(x), '<?xml') OR regexp_matches(trim(x), '^<\w+[^>]*>') THEN 'xml'
WHEN (starts_with(trim(x), '{') OR starts_with(trim(x), '[')) AND json_valid(trim(x)) THEN 'json' WHEN starts_with(trim(x), '---') AND contains(substr(trim(x), 1, 200), ':') THEN 'yaml'
WHEN len(string_split(trim(x), chr(10))) > 2 AND regexp_matches(string_split(trim(x), chr(10))[1], '^[-\w\s]+$') AND regexp_matches(string_split(trim(x), chr(10))[2], '^[-|=]+\s*$') THEN 'csv' ELSE 'txt' END"""


@query(f"SELECT kind, id, {_SNIFF} AS format FROM (SELECT 'event' AS kind, event_id AS id, props AS x FROM events UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents) s")
def d02_format_sniff(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("x"))
    p = t.read(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    c = _docs(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    return e.unionByName(p).unionByName(c).select("kind", "id", tx.sniff_format(F.col("x")).alias("format"))


@query(f"SELECT doc_id, CASE {' '.join(f'''WHEN regexp_matches({rules.sql_mark('t')}, '{rules.sql_pattern(w)}') THEN '{n}' ''' for n, w in rules.MODALITY_EN)} ELSE 'MUST' END AS modality FROM ({P}) x")
def e03_modality(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.modality(F.col("t")).alias("modality"))


def sql_sentences(t: str) -> str:
    """Stretches that end with . ! or ? before white space; a mark stands in for looking behind."""
    return f"list_filter(string_split(regexp_replace({t}, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


def _sql_has(text: str, phrases: str) -> str:
    return f"regexp_matches({rules.sql_mark(text)}, '{rules.sql_pattern(phrases)}')"


_KIND = "CASE " + " ".join(f"WHEN {_sql_has('sentence', words)} THEN '{name}'" for name, words in rules.MODALITY_EN) + " ELSE 'MUST' END"


@query(f"""SELECT *, modality IN ('FORBIDDEN', 'MUST_NOT', 'SHOULD_NOT') OR ({_sql_has('sentence', '|'.join(w for _, w in rules.MODALITY_EN))} AND {_sql_has('sentence', rules.NEGATED)}) AS negated
FROM (SELECT *, {_KIND} AS modality FROM (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS position, unnest(p) AS sentence FROM (SELECT doc_id, {sql_sentences('t')} AS p FROM ({P}) x) y) z) w""")
def e07_constraints(spark: SparkSession, d: str) -> DataFrame:
    return tx.constraints(_phrased(spark, d))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all({rules.sql_mark('t')}, '{rules.sql_pattern(rules.NEGATION_CUES_EN)}')) + len(regexp_extract_all({rules.sql_mark('t')}, '{rules.sql_pattern(rules.NEGATION_CONTRACTED_EN)}')) AS BIGINT) AS cues FROM ({P}) x")
def e08_negation_cues(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", tx.negation_cues(F.col("t")).cast("long").alias("cues"))


@query(f"SELECT sha256(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def f01_f02_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tx.exact_dedup(_docs(spark, d))


@query("SELECT doc_id, sha256(line) AS hash, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 50 GROUP BY 1, 2 HAVING count(*) > 1")
def f03_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return tx.repeated_lines(_docs(spark, d))


_SHINGLES = f"list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, CAST(CASE WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS BIGINT) AS shingles FROM (SELECT conv_id, turn, {_SHINGLES} AS w FROM conversations)")
def f04_shingles(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "conversations").select("conv_id", "turn", F.size(tx.shingles(F.col("text"))).cast("long").alias("shingles"))


@query(f"SELECT sha256(lower(trim(regexp_replace(text, '{WS}', ' ', 'g')))) AS hash, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1")
def f09_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return tx.duplicate_groups(_docs(spark, d))


_PAIRS = "SELECT conv_id, turn, text AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's text (b) with the text of the turn before it (a)."""
    c = t.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("b"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("a")).filter("a IS NOT NULL")


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda w: w <> ''))"


@query(f"SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 6) AS overlap FROM (SELECT conv_id, turn, {_SET.format('a')} AS x, {_SET.format('b')} AS y FROM ({_PAIRS}) p WHERE a IS NOT NULL)")
def f15_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.round(se.overlap(se.words(F.col("a")), se.words(F.col("b"))), 6).alias("overlap"))


@query(f"""SELECT doc_id, position, score, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS rank FROM (SELECT *, CAST(2 * len(regexp_extract_all(sentence, '[A-Za-z0-9_]{{7,}}'))
+ 3 * len(regexp_extract_all(sentence, '[0-9]+')) + len(regexp_extract_all(sentence, '\\b[A-Z][a-z]+')) + CASE WHEN position = 0 OR position = n - 1 THEN 2 ELSE 0 END AS INT) AS score
FROM (SELECT doc_id, len(p) AS n, CAST(generate_subscripts(p, 1) - 1 AS INT) AS position, unnest(p) AS sentence FROM (SELECT doc_id, {sql_sentences('t')} AS p FROM ({P}) x) y) z) w) v WHERE rank <= 2 OR n <= 3""")
def g27_key_sentences(spark: SparkSession, d: str) -> DataFrame:
    return tx.key_sentences(_phrased(spark, d))


@query("SELECT o_custkey, CASE WHEN count(*) = 1 THEN 'order | status | ' || max(o_orderkey) || ' | ' || max(o_orderstatus) ELSE 'order | status (' || count(*) || ' rows)' END AS compact FROM orders GROUP BY 1")
def g28_table_compaction(spark: SparkSession, d: str) -> DataFrame:
    rows = t.read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus")).alias("rows"))
    return rows.select("o_custkey", tx.table_compaction(F.array(F.lit("order"), F.lit("status")), F.col("rows")).alias("compact"))


_APPROX = "CAST(CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(floor(len(regexp_extract_all(trim({0}), '[A-Za-z0-9_]+')) * CAST(1.3 AS DOUBLE) + len(regexp_extract_all(trim({0}), '[^A-Za-z0-9_\\s\\x0B]')) * CAST(0.5 AS DOUBLE)), 1) END AS BIGINT)"


@query(f"SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN greatest(floor(floor(length(text) / CAST(3.5 AS DOUBLE)) * CAST(1.1 AS DOUBLE)), 1) WHEN 1 THEN greatest(length(text) // 4, 1) ELSE {_APPROX.format('text')} END AS BIGINT) AS tokens FROM documents")
def h01_tokens_by_provider(spark: SparkSession, d: str) -> DataFrame:
    provider = t.lookup({0: "anthropic", 1: "google", 2: "openai"}, F.col("doc_id") % 3)
    return _docs(spark, d).select("doc_id", me.tokens_by_provider(F.col("text"), provider).alias("tokens"))


@query(f"SELECT doc_id, {_APPROX.format('text')} AS tokens FROM documents")
def h02_approximate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", me.approximate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(greatest(length(text) // 4, 1) AS BIGINT) AS tokens FROM documents")
def h03_quarter_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", me.quarter_tokens(F.col("text")).alias("tokens"))


_FLUFFED = f"SELECT doc_id, t, {_sql_phrases('t', rules.FLUFF_EN)} AS c FROM ({P}) x"


@query(f"SELECT doc_id, round(1 - CAST(greatest(length(c) // 4, 1) AS DOUBLE) / greatest(length(t) // 4, 1), 6) AS reduction, CAST(length(t) - length(c) AS BIGINT) AS chars_saved, CAST(greatest(length(t) // 4, 1) - greatest(length(c) // 4, 1) AS BIGINT) AS tokens_saved FROM ({_FLUFFED}) f")
def h05_compression_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = _phrased(spark, d)
    return p.select("doc_id", me.compression(F.col("t"), tx.without_fluff(F.col("t"))).alias("m")).select("doc_id", "m.*")


def _sql_entropy(order: int) -> str:
    return f"""SELECT doc_id, CASE WHEN max(n) = 0 THEN 0 ELSE greatest(least(-sum(k / total * log2(k / total)) / log2(greatest(max(total), 2)), 1), CAST(0.1 AS DOUBLE)) END AS entropy FROM (
SELECT doc_id, g, max(n) AS n, CAST(count(*) AS DOUBLE) AS k, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE) AS total FROM (
SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - least({order}, greatest(len(w) - 1, 1)) + 2), lambda i: array_to_string(w[i:i + least({order}, greatest(len(w) - 1, 1)) - 1], ' '))) AS g
FROM (SELECT doc_id, {_SHINGLES} AS w FROM documents)) GROUP BY doc_id, g) GROUP BY doc_id"""


@query(f"SELECT doc_id, round(entropy, 6) AS entropy FROM ({_sql_entropy(4)}) e")
def h06_ngram_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(me.let(me.words(F.col("text")), lambda w: me.ngram_entropy(w, 4)), 6).alias("entropy"))


@query(f"SELECT doc_id, round(entropy, 6) AS entropy FROM ({_sql_entropy(3)}) e")
def h09_trigram_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(me.let(me.words(F.col("text")), lambda w: me.ngram_entropy(w, 3)), 6).alias("entropy"))


_REDUNDANT = f"SELECT doc_id, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(1 - least(len(list_distinct(w)) / greatest(sqrt(len(w)), 1) / 3, 1), 0) END AS redundancy FROM (SELECT doc_id, {_SHINGLES} AS w FROM documents)"


@query(f"SELECT doc_id, round(redundancy, 6) AS redundancy FROM ({_REDUNDANT}) r")
def h07_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(me.let(me.words(F.col("text")), me.redundancy), 6).alias("redundancy"))


_CODE = "```[A-Za-z0-9_]*\\n[^`]*\\n```"
_PROTECTED_SHARE = f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE list_sum(list_transform(regexp_extract_all(text, '{_CODE}'), lambda x: length(x))) / length(text) END AS p FROM documents"


@query(f"""SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE 1 - greatest(least(entropy * (1 - redundancy) + coalesce(p, 0) * CAST(0.5 AS DOUBLE), 1), 0) END, 6) AS headroom, round(greatest(least(CAST(0.1 AS DOUBLE) + entropy * CAST(0.2 AS DOUBLE) + coalesce(p, 0) * CAST(0.15 AS DOUBLE), CAST(0.5 AS DOUBLE)), CAST(0.05 AS DOUBLE)), 6) AS quenching_floor
FROM ({_sql_entropy(4)}) e JOIN ({_REDUNDANT}) r USING (doc_id) JOIN ({_PROTECTED_SHARE}) s USING (doc_id) JOIN (SELECT doc_id, len({_SHINGLES}) AS n FROM documents) w USING (doc_id)""")
def h08_h11_headroom(spark: SparkSession, d: str) -> DataFrame:
    """With fenced code as what is protected."""
    code = F.aggregate(F.transform(F.regexp_extract_all("text", F.lit(f"({_CODE})"), F.lit(1)), lambda x: F.length(x)), F.lit(0), lambda s, n: s + n)
    share = F.coalesce(F.try_divide(code, F.length("text")), F.lit(0.0))
    of = lambda w: F.struct(F.size(w).alias("n"), me.ngram_entropy(w, 4).alias("e"), me.redundancy(w).alias("r"))
    m = _docs(spark, d).select("doc_id", share.alias("p"), me.let(me.words(F.col("text")), of).alias("m")).select("doc_id", "p", "m.*")
    return m.select("doc_id", F.round(me.headroom(F.col("n"), F.col("e"), F.col("r"), F.col("p")), 6).alias("headroom"), F.round(me.quenching_floor(F.col("e"), F.col("p")), 6).alias("quenching_floor"))


@query()
def d11_d13_protected_share(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).select("doc_id", la.protected_ratio(F.col("text")).alias("ratio"))
    return x.select("doc_id", F.round("ratio", 6).alias("protected_ratio"), tx.rate_cap(F.col("ratio")).alias("rate_cap"))


@query()
def h12_integrity(spark: SparkSession, d: str) -> DataFrame:
    p = _phrased(spark, d)
    return p.select("doc_id", me.integrity(F.col("t"), tx.lexical(F.col("t"))).alias("m")).select("doc_id", "m.*")


@query()
def h16_factual_loss(spark: SparkSession, d: str) -> DataFrame:
    p = _phrased(spark, d)
    return p.select("doc_id", F.round(me.factual_loss(F.col("t"), F.regexp_replace("t", r"\d{4}-\d{2}-\d{2}", "")), 6).alias("factual_loss"))


@query(f"SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE least(len(regexp_extract_all({rules.sql_mark('text')}, '{rules.sql_pattern(rules.TRANSITIONS)}')) / greatest(n * CAST(0.1 AS DOUBLE), 1), 1) END, 6) AS novelty FROM (SELECT doc_id, text, len({_SHINGLES}) AS n FROM documents)")
def h17_novelty(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(me.novelty(F.col("text")), 6).alias("novelty"))


_W = f"list_filter(regexp_split_to_array({{0}}, '{WS}'), lambda x: x <> '')"
_BI = "list_distinct(CASE WHEN len({0}) < 2 THEN [] ELSE list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) END)"
_share = lambda x, y: f"len(list_intersect({x}, {y})) / CAST(greatest(len(list_distinct(list_concat({x}, {y}))), 1) AS DOUBLE)"
_n = lambda x: f"CAST({x} AS DOUBLE)"
_JUDGE = f"""SELECT *, CASE WHEN none THEN {_n(.5)} ELSE greatest(least(accuracy * {_n(.3)} + completeness * {_n(.25)} + coherence * {_n(.2)} + faithfulness * {_n(.15)} + style * {_n(.1)}, 1), 0) * CASE WHEN lb < la * {_n(.3)} THEN {_n(.7)} ELSE 1 END END AS score FROM (
SELECT conv_id, turn, none, la, lb, j AS accuracy, least(lb / CAST(greatest(la, 1) AS DOUBLE), 1) * {_n(.8)} + j * {_n(.2)} AS completeness, bi * {_n(.7)} + j * {_n(.3)} AS coherence,
  greatest(1 - nb / CAST(greatest(db, 1) AS DOUBLE), 0) AS faithfulness, 1 - least(abs(xa - xb) / greatest(xa + xb, 1), 1) AS style FROM (
SELECT conv_id, turn, coalesce(length(a), 0) = 0 OR coalesce(length(b), 0) = 0 AS none, len(wa) AS la, len(wb) AS lb, {_share('list_distinct(x)', 'list_distinct(y)')} AS j, {_share('ba', 'bb')} AS bi, len(list_distinct(y)) AS db,
  len(list_filter(list_distinct(y), lambda z: NOT list_contains(x, z))) AS nb, len(wa) / CAST(length(regexp_replace(a, '[^.!?]+', '', 'g')) + 1 AS DOUBLE) AS xa, len(wb) / CAST(length(regexp_replace(b, '[^.!?]+', '', 'g')) + 1 AS DOUBLE) AS xb FROM (
SELECT *, list_transform(wa, lambda q: lower(q)) AS x, list_transform(wb, lambda q: lower(q)) AS y, {_BI.format('wa')} AS ba, {_BI.format('wb')} AS bb FROM (
SELECT conv_id, turn, a, b, {_W.format('a')} AS wa, {_W.format('b')} AS wb FROM ({_PAIRS}) p WHERE a IS NOT NULL))))"""
_DIMS = ("accuracy", "completeness", "coherence", "faithfulness", "style")


@query(f"SELECT conv_id, turn, {', '.join(f'CASE WHEN none THEN NULL ELSE round({k}, 6) END AS {k}' for k in _DIMS)}, round(score, 6) AS score FROM ({_JUDGE}) j")
def h19_heuristic_judge(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", me.judge(F.col("a"), F.col("b")).alias("j")).select("conv_id", "turn", "j.*")


_ROUNDED = f"SELECT conv_id, turn, {', '.join(f'CASE WHEN none THEN 0 ELSE round({k}, 6) END AS {k}' for k in _DIMS)} FROM ({_JUDGE}) j"
_FAILED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} < {v} THEN '{k}' END" for k, v in zip(_DIMS, (0.80, 0.75, 0.70, 0.85, 0.60))) + "], lambda z: z IS NOT NULL), ',')"


@query(f"SELECT conv_id, turn, {_FAILED} = '' AS passed, CASE WHEN {_FAILED} = '' THEN 1 ELSE least({', '.join(_DIMS)}) END AS gate_score, {_FAILED} AS failed FROM ({_ROUNDED}) r")
def h23_oracle_gate(spark: SparkSession, d: str) -> DataFrame:
    j = _pairs(spark, d).select("conv_id", "turn", me.judge(F.col("a"), F.col("b")).alias("j"))
    return j.select("conv_id", "turn", me.oracle_gate(F.col("j")).alias("g")).select("conv_id", "turn", "g.*")


@query()
def h20_bleu(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.round(me.bleu(F.col("a"), F.col("b")), 6).alias("bleu"))


@query("SELECT o_orderkey, round((1 - p / CAST(greatest(o, 1) AS DOUBLE)) * 100, 1) AS savings_percent, CASE WHEN round((1 - p / CAST(greatest(o, 1) AS DOUBLE)) * 100, 1) < 50 THEN 'low' WHEN round((1 - p / CAST(greatest(o, 1) AS DOUBLE)) * 100, 1) < 65 THEN 'medium' ELSE 'high' END AS risk, CASE WHEN round((1 - p / CAST(greatest(o, 1) AS DOUBLE)) * 100, 1) > 30 THEN 'deploy' ELSE 'marginal' END AS recommendation FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS o, CAST(floor(o_totalprice * (o_orderkey % 10) / 10) AS BIGINT) AS p FROM orders)")
def g32_explain_optimisation(spark: SparkSession, d: str) -> DataFrame:
    o = t.read(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("o"), F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 10) / 10).cast("long").alias("p"))
    return o.select("o_orderkey", me.explain(F.col("o"), F.col("p")).alias("m")).select("o_orderkey", "m.*")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.vec_id AS query, v.vec_id AS id, list_inner_product(q.v, v.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(v.v, v.v)) + CAST(1e-9 AS DOUBLE)) AS cosine FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query, id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, id) AS rank FROM c QUALIFY rank <= 5""")
def c06_j02_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 20 the five most alike of all others."""
    v = t.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    out = le.nearest(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query"))
    return out.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))

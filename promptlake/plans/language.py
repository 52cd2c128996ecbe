"""Queries of detection, protection, compression pipelines, similar documents and text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, rules
from ..operators import compiler as co
from ..operators import language as la
from ..operators import measures as me
from ..operators import text as tx
from ..sources import tables as t
from .registry import query
from .texts import _APPROX, _LEXICAL, _SHINGLES, _docs, _pairs, _phrased, sql_sentences

P = t.PHRASED_SQL
_mark = rules.sql_mark


def _match(text: str, phrases: str) -> str:
    return f"regexp_matches({_mark(text)}, '{rules.sql_pattern(phrases)}')"


def _count(text: str, phrases: str) -> str:
    return f"len(regexp_extract_all({_mark(text)}, '{rules.sql_pattern(phrases)}'))"


@query("SELECT r.r_name AS region, n.n_name AS name, CAST(n.n_nationkey AS VARCHAR) AS key FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def a06_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations, written as a Markdown table and read again."""
    n, g = t.read(spark, d, "nation"), t.read(spark, d, "region")
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    by = n.groupBy("n_regionkey").agg(F.concat(F.lit("| name | key |\n|---|:-:|\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("text"))
    rows = by.join(F.broadcast(g), by["n_regionkey"] == g["r_regionkey"]).select(F.col("r_name").alias("region"), F.explode(la.markdown_rows(F.col("text"))).alias("c"))
    return rows.select("region", F.get("c", 0).alias("name"), F.get("c", 1).alias("key"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def a13_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "customer")
    line = F.to_csv(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal").schema)
    return c.select(F.from_csv(line, kinds).alias("x")).select("x.*")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a13_json_fields(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_NAMES = "CASE page_id % 5 WHEN 0 THEN 'a.MD' WHEN 1 THEN 'b/c.py' WHEN 2 THEN 'no suffix' WHEN 3 THEN 'x.tar.htm' ELSE 'y.docx' END"


@query(f"SELECT page_id, coalesce(CASE lower(regexp_extract({_NAMES}, '\\.([A-Za-z0-9]+)$', 1)) {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in lexicon.FORMATS.items())} END, 'txt') AS format FROM pages")
def a14_d03_format_of_name(spark: SparkSession, d: str) -> DataFrame:
    name = t.lookup({0: "a.MD", 1: "b/c.py", 2: "no suffix", 3: "x.tar.htm", 4: "y.docx"}, F.col("page_id") % 5)
    return t.read(spark, d, "pages").select("page_id", la.format_of_name(name).alias("format"))


_LINES = "string_split(t, chr(10))"


@query(f"""SELECT doc_id, {_APPROX.format('t')} AS tokens, CAST(length(t) AS BIGINT) AS chars, CAST(len({_SHINGLES.replace('text', 't')}) AS BIGINT) AS words,
CAST(len(list_filter({_LINES}, lambda x: regexp_matches(x, '^#{{1,6}} '))) AS BIGINT) AS sections, CAST(len(list_filter({_LINES}, lambda x: trim(x) <> '')) AS BIGINT) AS paragraphs, substr(t, 1, 200) AS preview FROM ({P}) x""")
def a15_document_metrics(spark: SparkSession, d: str) -> DataFrame:
    lines, c = F.split("t", "\n"), F.col("t")
    return _phrased(spark, d).select(
        "doc_id", me.approximate_tokens(c).alias("tokens"), F.length(c).cast("long").alias("chars"), F.size(me.words(c)).cast("long").alias("words"),
        F.size(F.filter(lines, lambda x: x.rlike("^#{1,6} "))).cast("long").alias("sections"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("paragraphs"), F.substring("t", 1, 200).alias("preview"),
    )


@query(f"SELECT doc_id, CASE WHEN fr > en AND fr > 1 THEN 'fr' ELSE 'en' END AS lang FROM (SELECT doc_id, {_count('t', lexicon.FRENCH)} AS fr, {_count('t', lexicon.ENGLISH)} AS en FROM ({P}) x)")
def d04_language(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", la.language(F.col("t")).alias("lang"))


@query()
def d07_d09_protection(spark: SparkSession, d: str) -> DataFrame:
    """How many spans of how many kinds are protected, and whether putting them back gives the text again."""
    p = _phrased(spark, d).withColumn("p", la.protect(F.col("t")))
    p = p.withColumn("back", la.reinject(F.col("p.text"), F.col("p.originals"), F.col("p.mark")))
    kinds, lost = F.size(F.array_distinct("p.originals.kind")).cast("long"), F.size(la.missing(F.col("back"), F.col("p.originals"), F.col("p.mark"))).cast("long")
    return p.select("doc_id", F.size("p.originals").cast("long").alias("spans"), kinds.alias("kinds"), (F.col("back") == F.col("t")).alias("restored"), lost.alias("missing"))


@query(f"SELECT o_orderkey, CASE WHEN cap >= CAST(0.7 AS DOUBLE) THEN 'max' WHEN cap >= CAST(0.55 AS DOUBLE) THEN 'aggressive' WHEN cap >= CAST(0.4 AS DOUBLE) THEN 'balanced' WHEN cap >= CAST(0.25 AS DOUBLE) THEN 'light' WHEN cap >= CAST(0.15 AS DOUBLE) THEN 'safe' ELSE 'bypass' END AS profile FROM (SELECT o_orderkey, CASE WHEN p >= CAST(0.3 AS DOUBLE) THEN CAST(0.15 AS DOUBLE) WHEN p >= CAST(0.15 AS DOUBLE) THEN CAST(0.25 AS DOUBLE) WHEN p >= CAST(0.05 AS DOUBLE) THEN CAST(0.4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cap FROM (SELECT o_orderkey, (o_orderkey % 50) / CAST(100 AS DOUBLE) AS p FROM orders))")
def d13_d14_max_profile(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "orders").select("o_orderkey", la.max_profile(tx.rate_cap((F.col("o_orderkey") % 50) / 100.0)).alias("profile"))


@query("""SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 50 THEN 'short' WHEN regexp_matches(text, '(?i)(def |class |function |import |from |public\\s+(class|void|int|string))') THEN 'code'
WHEN regexp_matches(text, '(?i)(Speaker|Participant|Agent)\\s*[0-9]+\\s*:') THEN 'meeting' WHEN regexp_matches("""
       + _mark("text") + """, '(?i)\\b(Article|Section|Clause|CONTRAT|CONVENU)') THEN 'legal' WHEN lang <> 'en' THEN 'multilingual' ELSE 'general' END AS kind FROM documents""")
def d17_text_type(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", la.text_type(F.col("text"), F.lit("txt"), F.col("lang")).alias("kind"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CASE WHEN noise THEN 1 ELSE 0 END) AS BIGINT) AS noise FROM (SELECT doc_id, x = '' OR regexp_matches(x, '^[0-9]{1,4}$') OR regexp_matches(x, '^page\\s+[0-9]+|^p\\.\\s*[0-9]+|^-\\s*[0-9]+\\s*-$') OR regexp_matches(x, 'copyright|©|all\\s+rights?\\s+reserved|confidential|disclaimer|proprietary|classified') OR (len(list_filter(regexp_split_to_array(x, '[\\s\\x0B]+'), lambda w: w <> '')) < 3 AND NOT regexp_matches(x, '[0-9]')) AS noise FROM (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS x FROM documents)) GROUP BY 1")
def d20_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.when(tx.is_noise(F.col("x")), 1).otherwise(0)).alias("noise"))


_STANCE = " ".join(f"WHEN {_match('t', p)} THEN '{n}'" for n, p in lexicon.STANCES_EN)


@query(f"SELECT doc_id, CASE {_STANCE} ELSE '' END AS stance, {_match('t', lexicon.AFFIXES)} AS affixal FROM ({P}) x")
def e04_e09_stance(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", la.stance(F.col("t")).alias("stance"), la.has_affixal_negation(F.col("t")).alias("affixal"))


_CONSOLIDATED = "lower(t)"
for _old, _new in lexicon.DOUBLE_NEGATIONS:
    _CONSOLIDATED = f"replace({_CONSOLIDATED}, '{_old}', '{_new}')"


@query(f"SELECT doc_id, sha256({_CONSOLIDATED}) AS consolidated FROM (SELECT doc_id, concat(t, ' It is Not Impossible, and not without reason.') AS t FROM ({P}) x) y")
def e11_consolidate_negations(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("t", F.lit(" It is Not Impossible, and not without reason."))
    return _phrased(spark, d).select("doc_id", F.sha2(la.consolidate_negations(text), 256).alias("consolidated"))


@query(f"""SELECT doc_id, trim(s) AS segment FROM (SELECT doc_id, unnest({sql_sentences('t')}) AS s FROM ({P}) x) y WHERE {_match('s', rules.NEGATION_CUES_EN)} OR {_match('s', rules.NEGATION_CONTRACTED_EN)}""")
def e12_negated_segments(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", F.explode(la.negated_segments(F.col("t"))).alias("segment"))


@query(f"SELECT doc_id, sha256({rules.sql_marked(rules.sql_marked('t', lambda x: f'''regexp_replace({x}, '{rules.sql_pattern(rules.NEGATION_CUES_EN)}', '#\\1#', 'g')'''), lambda x: f'''regexp_replace({x}, '{rules.sql_pattern(rules.NEGATION_CONTRACTED_EN)}', '#\\1#', 'g')''')}) AS marked FROM ({P}) x")
def e13_mark_negated(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("doc_id", F.sha2(F.replace(la.mark_negated(F.col("t")), F.lit("¬"), F.lit("#")), 256).alias("marked"))


@query()
def e18_e19_f12_clean_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences without talk about the request, without what is taken back, and without repeats."""
    p = _phrased(spark, d).withColumn("t", F.concat("t", F.lit(" Add a table. Scratch that. Add a list of items. Add a list of the items.")))
    kept = la.without_repeats(la.without_cancelled(tx.sentences(la.without_request_talk(F.col("t")))))
    return p.select("doc_id", F.size(kept).cast("long").alias("sentences"), F.element_at(kept, -1).alias("last"))


@query()
def e20_e24_features(spark: SparkSession, d: str) -> DataFrame:
    """Task, specificity and length of each user prompt."""
    c = F.concat_ws(" ", "text", t.lookup(dict(enumerate(t.PHRASES)), F.col("conv_id") % len(t.PHRASES)))
    p = t.session_prompts(spark, d).select("conv_id", "turn", c.alias("text"))
    return p.select("conv_id", "turn", la.task(F.col("text")).alias("task"), la.specificity(F.col("text")).alias("specificity"), t.length_bucket(me.approximate_tokens(F.col("text"))).alias("length"))


_PREFERENCES = " UNION ALL ".join(f"SELECT source AS user_id, '{k}' AS kind, '{v}' AS value, doc_id AS told, {i} AS i FROM p WHERE {_match('t', w)}" for i, (k, v, w) in enumerate(lexicon.PREFERENCES))
_PREFERRED = f"WITH p AS (SELECT d.source, x.doc_id, x.t FROM ({P}) x JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL), q AS (SELECT user_id, kind, max_by(value, told * 10 + i) AS value FROM ({_PREFERENCES}) u GROUP BY 1, 2)"


def _preferences(spark: SparkSession, d: str) -> DataFrame:
    p = _phrased(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id").filter("source IS NOT NULL")
    return la.preferences(p.select(F.col("source").alias("user_id"), F.col("doc_id").alias("at"), F.col("t").alias("text")))


@query(f"{_PREFERRED} SELECT * FROM q")
def e25_preferences(spark: SparkSession, d: str) -> DataFrame:
    return _preferences(spark, d)


@query(f"""{_PREFERRED} SELECT user_id, concat_ws('. ', 'Writes in ' || max(value) FILTER (kind = 'language'), 'Prefers a tone ' || max(value) FILTER (kind = 'tone'), 'Favourite format: ' || max(value) FILTER (kind = 'format')) AS summary FROM q GROUP BY 1""")
def j05_user_summaries(spark: SparkSession, d: str) -> DataFrame:
    return la.user_summaries(_preferences(spark, d))


_WORDS3 = f"SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM (SELECT doc_id, {_SHINGLES.replace('text', chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS w FROM documents)"


@query(f"""WITH x AS ({_WORDS3}), y AS (SELECT min(doc_id) AS doc_id, any_value(s) AS s FROM (SELECT doc_id, s, list_sort(s) AS k FROM x) GROUP BY k), z AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM y)
SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE), 6) AS jaccard FROM z a JOIN z b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))""")
def c03_f10_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return la.similar_pairs(_docs(spark, d))


@query()
def f05_f06_minhash(spark: SparkSession, d: str) -> DataFrame:
    """Estimated and exact likeness of each turn and the one before it."""
    p = _pairs(spark, d).select("conv_id", "turn", tx.shingles(F.col("a"), 1).alias("a"), tx.shingles(F.col("b"), 1).alias("b"))
    exact = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return p.select("conv_id", "turn", F.round(la.minhash_likeness(la.minhash(F.col("a")), la.minhash(F.col("b"))), 6).alias("estimate"), F.round(exact, 6).alias("exact"))


@query()
def g30_compiled(spark: SparkSession, d: str) -> DataFrame:
    """Documents compressed by the balanced profile: lengths, protected spans and those lost, errors, and whether the original must be taken."""
    found = co.compiled(_phrased(spark, d))
    return found.select("doc_id", F.length("t").cast("long").alias("before"), F.length("compressed").cast("long").alias("after"), F.col("spans").cast("long"), F.col("lost").cast("long"), F.array_join("validation", ";").alias("errors"), "fall_back")


@query()
def g30_compiled_industrial(spark: SparkSession, d: str) -> DataFrame:
    """The same by the industrial profile, with its errors of quality."""
    found = co.compiled(_phrased(spark, d), "industrial")
    return found.select("doc_id", F.length("t").cast("long").alias("before"), F.length("compressed").cast("long").alias("after"), F.col("spans").cast("long"), F.array_join(F.concat("validation", "quality"), ";").alias("errors"), "fall_back")


_WORDS_HASHED = "list_transform(" + _SHINGLES.replace("text", "{0}") + ", lambda w: substr(sha256(w), 1, 3))"
_BOTH = "list_sum(list_transform({0}, lambda x: len(list_filter({1}, lambda y: y = x))))"


@query(f"""SELECT doc_id, round(similarity, 4) AS similarity, round(ratio, 3) AS token_ratio, CASE WHEN similarity < CAST(0.6 AS DOUBLE) THEN 'similarity' ELSE '' END AS errors
FROM (SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1 ELSE {_BOTH.format('a', 'b')} / sqrt(CAST({_BOTH.format('a', 'a')} * {_BOTH.format('b', 'b')} AS DOUBLE)) END AS similarity,
CASE WHEN length(t) // 4 = 0 THEN 1 ELSE (length(c) // 4) / CAST(length(t) // 4 AS DOUBLE) END AS ratio FROM (SELECT *, {_WORDS_HASHED.format('t')} AS a, {_WORDS_HASHED.format('c')} AS b FROM (SELECT doc_id, t, substr(t, 1, length(t) // 3) AS c FROM ({P}) x) y) z) w""")
def h14_quality(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to a third against themselves: similarity, token ratio and the errors but for critical content."""
    p = _phrased(spark, d).withColumn("q", co.quality(F.col("t"), F.left("t", F.floor(F.length("t") / 3).cast("int"))))
    return p.select("doc_id", "q.similarity", "q.token_ratio", F.array_join(F.filter("q.errors", lambda x: ~x.startswith("critical")), ";").alias("errors"))


@query(f"SELECT doc_id, o AS original_tokens, c AS compressed_tokens, round((1 - c / CAST(greatest(o, 1) AS DOUBLE)) * 100, 1) AS savings_percent, round((1 - c / CAST(greatest(o, 1) AS DOUBLE)) * 100, 1) > 10 AS compressible FROM (SELECT doc_id, {_APPROX.format('t')} AS o, {_APPROX.format('c')} AS c FROM (SELECT doc_id, t, {_LEXICAL} AS c FROM ({P}) x) y) z")
def g31_compressibility(spark: SparkSession, d: str) -> DataFrame:
    p = _phrased(spark, d).select("doc_id", me.approximate_tokens(F.col("t")).alias("original_tokens"), me.approximate_tokens(tx.lexical(F.col("t"))).alias("compressed_tokens"))
    p = p.withColumn("savings_percent", F.round((1 - F.col("compressed_tokens") / F.greatest("original_tokens", F.lit(1))) * 100, 1))
    return p.withColumn("compressible", F.col("savings_percent") > 10)


_SENT = f"SELECT *, role = 'user' AND length(trim(coalesce(t, ''))) > 0 AND length(t) >= 30 AS tried, {_APPROX.format('c')} < CAST(0.9 AS DOUBLE) * {_APPROX.format('t')} AS good FROM (SELECT conv_id, turn, role, t, {_LEXICAL} AS c FROM (SELECT conv_id, turn, role, concat_ws(' ', text, CASE conv_id % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(t.PHRASES)) + " END) AS t FROM conversations) x) y"


@query(f"SELECT conv_id, turn, role, CASE WHEN tried AND good THEN c ELSE t END AS sent, tried AND NOT good AS fallback, CASE WHEN tried THEN len({_SHINGLES.replace('text', 't')}) ELSE 0 END AS original_words, CASE WHEN tried THEN len({_SHINGLES.replace('text', 'CASE WHEN good THEN c ELSE t END')}) ELSE 0 END AS sent_words FROM ({_SENT}) z")
def g33_message_compression(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations").withColumn("text", F.concat_ws(" ", "text", t.lookup(dict(enumerate(t.PHRASES)), F.col("conv_id") % len(t.PHRASES))))
    out = la.compressed_messages(c, tx.lexical(F.col("text")), me.approximate_tokens)
    return out.withColumns({x: F.col(x).cast("long") for x in ("original_words", "sent_words")})


@query("SELECT o_orderkey, round(greatest(least(CASE WHEN e < CAST(0.4 AS DOUBLE) THEN CAST(0.3 AS DOUBLE) WHEN e < CAST(0.6 AS DOUBLE) THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END + p * CAST(0.3 AS DOUBLE), CAST(0.95 AS DOUBLE)), CAST(0.15 AS DOUBLE)), 6) AS threshold FROM (SELECT o_orderkey, (o_orderkey % 100) / CAST(100 AS DOUBLE) AS e, (o_orderkey % 7) / CAST(7 AS DOUBLE) AS p FROM orders)")
def h10_safe_threshold(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "orders").select("o_orderkey", F.round(me.safe_threshold((F.col("o_orderkey") % 100) / 100.0, (F.col("o_orderkey") % 7) / 7.0), 6).alias("threshold"))


_GONE = ", ".join(
    f"list_transform(list_filter(list_distinct(regexp_extract_all(t, '{p}')), lambda x: length(x) > 5 AND NOT list_contains(regexp_extract_all(c, '{p}'), x)), lambda x: '{label}')" for label, p in lexicon.CRITICAL
)


@query(f"SELECT doc_id, array_to_string(flatten([{_GONE}]), ',') AS missing FROM (SELECT doc_id, t, regexp_replace(t, 'https?://\\S+|\\S+@\\S+', '', 'g') AS c FROM ({P}) x) y")
def h13_critical_content(spark: SparkSession, d: str) -> DataFrame:
    """Which addresses, code and data a text without its links and addresses lacks."""
    cut = F.when(F.contains("t", F.lit("://")) | F.contains("t", F.lit("@")), F.regexp_replace("t", r"https?://\S+|\S+@\S+", "")).otherwise(F.col("t"))
    p = _phrased(spark, d).withColumn("cut", cut)
    return p.select("doc_id", F.array_join(la.critical_missing(F.col("t"), F.col("cut")), ",").alias("missing"))


@query("SELECT o_orderkey, loss > CAST(0.15 AS DOUBLE) AND novelty < loss AS retry FROM (SELECT o_orderkey, (o_orderkey % 50) / CAST(100 AS DOUBLE) AS loss, (o_orderkey % 7) / CAST(20 AS DOUBLE) AS novelty FROM orders)")
def h18_retry_rule(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "orders").select("o_orderkey", me.retry((F.col("o_orderkey") % 50) / 100.0, (F.col("o_orderkey") % 7) / 20.0).alias("retry"))


@query()
def h21_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.round(me.rouge_l(F.col("a"), F.col("b")), 6).alias("rouge_l"))



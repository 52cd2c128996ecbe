from pyspark.sql import functions as F

from promptlake.operators import measures as me
from promptlake.operators import sessions as se
from promptlake.operators import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_rewrites(spark):
    c = F.col("t")
    assert one(spark, tx.logical(c), t="Because it rains; however, go.") == "as it rains; but, go."
    assert one(spark, tx.shorten(c), t="In order to win, a large number of us") == "to win, many us"
    assert one(spark, tx.lexical(c), t="Please note it is very , very good") == "note it is, good"
    assert one(spark, tx.structural(c), t="#   A  \n---\n\n\n\nb   ") == "# A\n\nb"
    assert one(spark, tx.light_clean(c), t="so!!! really??  yes") == "so! ? yes"


def test_word_ends_are_unicode(spark):
    assert one(spark, tx.logical(F.col("t")), t="Así sincère since") == "Así sincère as"


def test_modality_and_negation(spark):
    for text, kind in (("You must not go", "MUST_NOT"), ("it is forbidden", "FORBIDDEN"), ("you may go", "MAY"), ("plain", "MUST"), ("never should", "SHOULD")):
        assert one(spark, tx.modality(F.col("t")), t=text) == kind
    rows = tx.constraints(spark.createDataFrame([(1, "You must go. He should never do it!")], "doc_id long, t string")).orderBy("position").collect()
    assert [(r.modality, r.negated) for r in rows] == [("MUST", False), ("SHOULD", True)]


def test_sniff(spark):
    for text, kind in (("", "txt"), ("<html><p>", "html"), ("<a b='c'>", "xml"), ('{"a": 1}', "json"), ("{a", "txt"), ("---\na: b", "yaml"), ("a b\n---\nc", "csv")):
        assert one(spark, tx.sniff_format(F.col("t")), t=text) == kind


def test_bleu_of_equal_and_disjoint_texts(spark):
    assert abs(one(spark, me.bleu(F.col("a"), F.col("b")), a="the cat sat on the mat", b="the cat sat on the mat") - 1) < 1e-9
    assert one(spark, me.bleu(F.col("a"), F.col("b")), a="a b c d", b="e f g h") < 1e-9
    assert one(spark, me.bleu(F.col("a"), F.col("b")), a="", b="e f g h") == 0


def test_entropy_bounds(spark):
    e = me.ngram_entropy(me.words(F.col("t")), 3)
    assert one(spark, e, t="") == 0
    assert one(spark, e, t="a a a a a a a a") == 0.1
    assert abs(one(spark, e, t="a b c d e f") - 1) < 1e-9


def test_overlap(spark):
    assert one(spark, se.overlap(se.words(F.col("a")), se.words(F.col("b"))), a="A b c", b="b C d") == 0.5
    assert one(spark, se.overlap(se.words(F.col("a")), se.words(F.col("b"))), a="", b="") == 0

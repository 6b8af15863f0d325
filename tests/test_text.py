import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import textcols as T


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [
    ("eﬃcient ﬁelds ﬂow ﬀ ﬄ", "efficient fields flow ff ffl"),
    ("it’s “so” 3–4—5", "it's \"so\" 3-4-5"),
    ("multi-\nmodal", "multimodal"),
    ("multi–\nmodal", "multimodal"),
    ("multi-\nModal", "multi- Modal"),
    ("a \n\t b", "a b"),
    ("a  \t b\tc", "a b\tc"),
    ("  a ", "a"),
    ("", ""),
])
def test_clean(spark, raw, want):
    assert one(spark, T.clean, raw) == want


@pytest.mark.parametrize(("text", "noise"), [
    ("12", True), ("Table 4 continued", True), ("12.5 3.4 xi - 7.7 8.8 iv 10.1 9", True),
    ("0.5 12.3 44.1 a 99.1 12 (33) 1", True), ("A sentence with enough letters in it.", False),
    ("Été à côté, où règne l'ambiguïté", False),
])
def test_noise(spark, text, noise):
    assert one(spark, T.is_noise, text) is noise


def test_sentences_split_after_marks_only(spark):
    assert one(spark, T.sentences, "One. Two!  Three? 3.5 is four") == ["One.", "Two!", "Three?", "3.5 is four"]


def test_tokens_keep_repeats_and_split_at_accents(spark):
    assert one(spark, T.tokenize, "The naïve 30,000 WORDS of words") == ["na", "ve", "30", "000", "words", "words"]


def test_normalise_folds_font_variants(spark):
    assert one(spark, T.normalise, " Mixed  CASE\n\U0001d465² ﬁ x ") == "mixed case x2 fi x"


def test_cited_numbers(spark):
    assert one(spark, T.cited_numbers, "a [1] b [2, 3] c [1] d [x] e [ 4]") == [1, 2, 3]
    assert one(spark, T.cited_numbers, "none") == [None]


@pytest.mark.parametrize(("body", "want"), [
    ('{"message": "too  fast"}', "too fast"), ('{"detail": "limit"}', "limit"), ("<html>\n bad</html>", "<html> bad</html>"),
    ("", "no details"), ("x" * 300, "x" * 200),
])
def test_reason(spark, body, want):
    assert one(spark, T.reason, body) == want


def test_labels_and_shares(spark):
    df = spark.createDataFrame([(5, 8, 0, [("a.pdf", 1), ("b.pdf", 2)])], "m int, n int, z int, p array<struct<source:string,page:int>>")
    r = df.select(T.share("m", "n").alias("a"), T.share("z", "z").alias("b"), T.page_labels("p").alias("c"), T.fixed(F.lit(0.71)).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("5 of 8 (62.5%)", "0 of 0 (0%)", "a.pdf p.1, b.pdf p.2", "0.710")


def test_share_of_none_of_some(spark):
    df = spark.createDataFrame([(0, 12), (0, 0), (3, 12)], "m long, n long")
    assert [r.a for r in df.select(T.share("m", "n").alias("a")).collect()] == ["0 of 12 (0.0%)", "0 of 0 (0%)", "3 of 12 (25.0%)"]


def test_skips_change_no_text(spark):
    """Texts with every white space character, marks that compose, and signs that compatibility composition changes."""
    r = random.Random(5)
    signs = [*T.WHITE, *"aZ.-éß’ﬁ²ªµ½¨\u0301\u2460ſŀ中", "  ", "-\n", "\x1c", "\x00", "\u200b"]
    texts = ["".join(r.choices(signs, k=r.randrange(9))) for _ in range(400)] + [f"{c}x{c}" for c in signs] + [chr(c) + "\u0301" for c in range(0x80, 0x180)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    t = F.col("t")
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    folded = t
    for bad, good in T.LIGATURES.items():
        folded = F.replace(folded, F.lit(bad), F.lit(good))
    folded = F.translate(folded, T.FOLD_FROM, T.FOLD_TO)
    clean = bare(F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, r"-\n(?=[a-z])", ""), r"(?U)\s*\n\s*", " "), r"[ \t]{2,}", " "))
    normal = bare(F.regexp_replace(F.lower(T.nfkc()(t)), r"(?U)\s+", " "))
    for x in df.select("t", T.strip(t), bare(t), T.clean(t), clean, T.normalise(t), normal).toDF("t", "a", "a1", "b", "b1", "c", "c1").collect():
        assert (x.a, x.b, x.c) == (x.a1, x.b1, x.c1), repr(x.t)
    plain = df.sparkSession.createDataFrame([("Größe, «ça» ±1°",)], "t string").select(F.rlike("t", F.lit(T.FORMS)).alias("x"))
    assert plain.first().x is False  # Latin-1 goes without the Python step

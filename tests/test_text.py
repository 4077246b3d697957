"""T1-T9 on inline fixtures (FIXTURES.md 3.1)."""

import pytest
from pyspark.sql import functions as F

from parallax.functions import text as T

CASES = [
    ("يَلّا فين؟", "يلا فين", "يلا فين", 0.0, False),
    ("  أنا   محتاج\tأتكلم معاكي ", "أنا محتاج أتكلم معاكي", "انا محتاج اتكلم معاكي", 0.0, False),
    ("\"'مدرسة'\"", "مدرسة", "مدرسه", 0.0, False),
    (" \"كويس\"", "\"كويس", "\"كويس", 0.0, False),
    ("؟،", "", "", None, False),
    ("مسؤول إلى شئ", "مسؤول إلى شئ", "مسوول الي شي", 0.0, False),
    ("OK yes حاضر", "OK yes حاضر", "OK yes حاضر", 2 / 3, False),
    ("yes no ok حاضر", "yes no ok حاضر", "yes no ok حاضر", 3 / 4, True),
    ("\"ok\"", "ok", "ok", 1.0, True),
    ("x1 ok", "x1 ok", "x1 ok", 0.5, False),
    ("'\"x\"'", "\"x\"", "\"x\"", 0.0, False),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string")
    out = df.select("i", T.clean_text("s").alias("c"), T.clean_text("s", True).alias("n"))
    out = out.select("i", "c", "n", T.english_token_ratio("c").alias("r"), T.is_mostly_english("c").alias("f"))
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_clean_and_flag(cleaned, i):
    _, clean, normed, ratio, flag = CASES[i]
    row = cleaned[i]
    assert row.c == clean
    assert row.n == normed
    if ratio is None:
        assert row.r is None
    else:
        assert row.r == pytest.approx(ratio)
    assert row.f is flag


def test_diacritic_ranges_match_python(spark):
    import re
    pat = re.compile(r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E4\u06E7\u06E8\u06EA-\u06ED]")
    chars = "".join(chr(c) for c in range(0x0600, 0x0700))
    got = spark.range(1).select(T.remove_vocalization(F.lit(chars)).alias("x")).first().x
    assert got == pat.sub("", chars)


def test_whitespace_class_matches_python(spark):
    chars = "".join(chr(c) for c in range(1, 0x3100) if not (0xD800 <= c <= 0xDFFF))
    got = spark.range(1).select(T.whitespace_tokens(F.lit("a" + chars + "b")).alias("t")).first().t
    assert got == ("a" + chars + "b").split()


def test_english_only(spark):
    rows = [("Hello, world!",), ("مرحبا",), ("a\tb (c) = d+e",), ("",)]
    out = spark.createDataFrame(rows, "s string").select(T.is_english_only("s").alias("e")).collect()
    assert [r.e for r in out] == [True, False, True, False]


def test_prompt_and_postprocess(spark):
    df = spark.createDataFrame([("ازيك", "اهلا\nsecond line")], "src string, tgt string")
    p = df.select(T.generation_prompt("src", quoted=True).alias("p"), "tgt")
    out = p.select("p", T.postprocess_completion(F.concat("p", "tgt"), F.col("p")).alias("c")).first()
    assert out.p == 'عامية: "ازيك"\nفصحى: '
    assert out.c == "اهلا"


def test_character_sets_agree(spark):
    """The classes, the literal characters and Java's property are the same sets."""
    import sys

    from parallax import constants as K

    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(chr(c),) for c in points if c < 0x10000] + [("😀",)], "c string")
    for cls, chars in ((K.DIACRITICS_CLASS, K.DIACRITIC_CHARS), (K.ARABIC_PUNCT_CLASS, K.ARABIC_PUNCT_CHARS),
                       (K.WS_CLASS, K.WS_LITERAL), (K.JWS_CLASS, K.WS_LITERAL)):
        got = {r.c for r in df.filter(F.col("c").rlike("^" + cls + "$")).collect()}
        assert got == set(chars)
    assert set(K.WS_LITERAL) == {chr(c) for c in points if chr(c).isspace()}

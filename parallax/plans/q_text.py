"""Registered text-function queries (T1-T12) over whole documents / pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import text as T
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.registry import query


@query("t01_remove_vocalization",
       S.with_(S.AR_DOCS) + f"SELECT doc_id, {S.vocal('text')} AS out FROM ar_docs")
def t01(spark, sf):
    return I.ar_documents(spark, sf).select("doc_id", T.remove_vocalization("text").alias("out"))


@query("t02_arabic_punctuation",
       S.with_(S.AR_DOCS) + f"SELECT doc_id, {S.punct('text')} AS out FROM ar_docs")
def t02(spark, sf):
    return I.ar_documents(spark, sf).select(
        "doc_id", T.replace_arabic_punctuation("text").alias("out"))


# Quote wrappers in four arrangements so both strip orders are exercised.
_WRAP_SQL = ("CASE doc_id % 4 WHEN 0 THEN '\"' || text || '\"' "
             "WHEN 1 THEN '''\"' || text || '\"''' "
             "WHEN 2 THEN ' \"' || text || '\"' ELSE '\"''' || text || '''\"' END")


def _wrapped(c):
    m = F.col("doc_id") % 4
    return (F.when(m == 0, F.concat(F.lit('"'), c, F.lit('"')))
            .when(m == 1, F.concat(F.lit("'\""), c, F.lit("\"'")))
            .when(m == 2, F.concat(F.lit(' "'), c, F.lit('"')))
            .otherwise(F.concat(F.lit("\"'"), c, F.lit("'\""))))


@query("t03_strip_quotes",
       S.with_(S.AR_DOCS) + f"SELECT doc_id, {S.quotes(_WRAP_SQL)} AS out FROM ar_docs")
def t03(spark, sf):
    return I.ar_documents(spark, sf).select(
        "doc_id", T.strip_outer_quotes(_wrapped(F.col("text"))).alias("out"))


@query("t04_remove_extra_whitespace",
       S.with_(S.AR_DOCS) + f"SELECT doc_id, {S.ws('text')} AS out FROM ar_docs")
def t04(spark, sf):
    return I.ar_documents(spark, sf).select(
        "doc_id", T.remove_extra_whitespace("text").alias("out"))


@query("t05_normalize_arabic",
       S.with_(S.AR_DOCS) + f"SELECT doc_id, {S.norm('text')} AS out FROM ar_docs")
def t05(spark, sf):
    return I.ar_documents(spark, sf).select("doc_id", T.normalize_arabic("text").alias("out"))


@query("t06_clean_text",
       S.with_(S.AR_DOCS) + f"SELECT doc_id, {S.clean('text')} AS clean, "
       f"{S.clean('text', True)} AS clean_normalized FROM ar_docs")
def t06(spark, sf):
    return I.ar_documents(spark, sf).select(
        "doc_id", T.clean_text("text").alias("clean"),
        T.clean_text("text", normalize=True).alias("clean_normalized"))


@query("t07_english_ratio",
       f"SELECT doc_id, {S.en_ratio('text')} AS ratio FROM documents")
def t07(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", T.english_token_ratio("text").alias("ratio"))


@query("t08_mostly_english",
       f"SELECT doc_id, lang, {S.mostly_english('text')} AS mostly_english, "
       f"{S.mostly_english(S.clean(S.translit('text')))} AS mostly_english_ar FROM documents")
def t08(spark, sf):
    d = I.table(spark, sf, "documents").select(
        "doc_id", "lang", "text", T.clean_text(T.transliterate_to_arabic("text")).alias("ar"))
    return d.select("doc_id", "lang", T.is_mostly_english("text").alias("mostly_english"),
                    T.is_mostly_english("ar").alias("mostly_english_ar"))


@query("t09_english_only",
       f"SELECT doc_id, {S.english_only('text')} AS english_only FROM documents")
def t09(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", T.is_english_only("text").alias("english_only"))


@query("t10_prompts",
       S.with_(S.CONV_PAIRS) + "SELECT pair_id, "
       f"{S.template(K.GEN_PROMPT, slang='src')} AS gen_prompt, "
       f"{S.template(K.GEN_PROMPT_QUOTED, slang='src')} AS gen_prompt_quoted, "
       f"{S.template(K.DET_PROMPT, slang='src', formal='tgt')} AS det_prompt FROM conv_pairs")
def t10(spark, sf):
    p = I.conv_pairs(spark, sf)
    return p.select("pair_id", T.generation_prompt("src").alias("gen_prompt"),
                    T.generation_prompt("src", quoted=True).alias("gen_prompt_quoted"),
                    T.detection_prompt("src", "tgt").alias("det_prompt"))


def _t11_sql() -> str:
    prompt = S.template(K.GEN_PROMPT_QUOTED, slang="src")
    out = f"({prompt} || tgt)"
    rest = f"substring({out}, length({prompt}) + 1)"
    first = f"split_part({rest}, chr(10), 1)"
    return S.with_(S.CONV_PAIRS) + f"SELECT pair_id, {S.strip(first)} AS completion FROM conv_pairs"


@query("t11_postprocess_completion", _t11_sql())
def t11(spark, sf):
    p = I.conv_pairs(spark, sf).withColumn("prompt", T.generation_prompt("src", quoted=True))
    out = F.concat("prompt", "tgt")
    return p.select("pair_id", T.postprocess_completion(out, F.col("prompt")).alias("completion"))


@query("t12_label_names",
       "SELECT doc_id, CASE WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS quality_label, "
       "CASE WHEN toxic = 1 THEN 'correct' ELSE 'incorrect' END AS toxic_label, "
       "CAST(CASE WHEN quality = 1 THEN 1 ELSE 0 END AS INTEGER) AS quality_roundtrip FROM labels")
def t12(spark, sf):
    lab = I.table(spark, sf, "labels")
    return lab.select("doc_id", T.label_name("quality").alias("quality_label"),
                      T.label_name("toxic").alias("toxic_label"),
                      T.label_value(T.label_name("quality")).cast("int").alias("quality_roundtrip"))

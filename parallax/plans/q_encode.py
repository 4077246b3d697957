"""Registered model-input queries: V1-V5 (vocabulary from DOC, inputs from CONV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import arrays as V
from parallax.functions import text as T
from parallax.operators import encode as E
from parallax.operators.positional import random_positions
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.registry import query


def vocabulary(spark, sf):
    return E.build_vocabulary(I.table(spark, sf, "documents"))


def encoded_pairs(spark, sf):
    """CONV pairs with generation prompt, detection prompt and target encoded."""
    p = I.conv_pairs(spark, sf).select(
        "pair_id", T.generation_prompt("src").alias("gen_prompt"),
        T.detection_prompt("src", "tgt").alias("det_prompt"), "tgt")
    return E.encode(p, "pair_id", ["gen_prompt", "det_prompt", "tgt"], vocabulary(spark, sf))


def generation_examples(spark, sf):
    e = encoded_pairs(spark, sf)
    ex = e.select("pair_id", V.generation_example("gen_prompt_ids", "tgt_ids", E.EOS_ID).alias("x"))
    return ex.select("pair_id", "x.input_ids", "x.labels")


# -- oracle views -----------------------------------------------------------

VOCAB_SQL = f"""vocab AS (
  SELECT token, count, row_number() OVER (ORDER BY count DESC, token) + {E.FIRST_TOKEN_ID - 1} AS id
  FROM (SELECT token, count(*) AS count
        FROM (SELECT unnest({S.tokens('text')}) AS token FROM documents) GROUP BY token))"""


def _enc_sql(cols: dict[str, str]) -> str:
    """Encode CONV-pair text expressions (name -> SQL expr) into <name>_ids."""
    sides = "\n  UNION ALL ".join(
        f"SELECT pair_id, {i} AS side, unnest(t) AS tok, generate_subscripts(t, 1) AS pos "
        f"FROM (SELECT pair_id, {S.tokens(expr)} AS t FROM conv_pairs)"
        for i, expr in enumerate(cols.values()))
    lists = ",\n       ".join(
        f"coalesce(list(CAST(coalesce(v.id, {E.UNK_ID}) AS INTEGER) ORDER BY x.pos) "
        f"FILTER (WHERE x.side = {i}), []::INTEGER[]) AS {name}_ids"
        for i, name in enumerate(cols))
    return f"""ex AS ({sides}),
enc0 AS (SELECT x.pair_id, {lists}
         FROM ex x LEFT JOIN vocab v ON x.tok = v.token GROUP BY x.pair_id),
enc AS (SELECT c.pair_id, {', '.join(f"coalesce(e.{n}_ids, []::INTEGER[]) AS {n}_ids" for n in cols)}
        FROM conv_pairs c LEFT JOIN enc0 e ON c.pair_id = e.pair_id)"""


ENC_SQL = S.CONV_PAIRS + ",\n" + VOCAB_SQL + ",\n" + _enc_sql({
    "gen_prompt": S.template(K.GEN_PROMPT, slang="src"),
    "det_prompt": S.template(K.DET_PROMPT, slang="src", formal="tgt"),
    "tgt": "tgt"})

GENEX_SQL = ENC_SQL + f""",
genex AS (
  SELECT pair_id, list_concat(pr, tg) AS input_ids,
         list_concat(list_transform(range(len(pr)), lambda x: {K.IGNORE_INDEX}), tg) AS labels
  FROM (SELECT pair_id,
               list_slice(gen_prompt_ids, greatest(len(gen_prompt_ids) - {K.GEN_MAX_INPUT_LEN} + 1, 1),
                          len(gen_prompt_ids)) AS pr,
               list_slice(list_concat(tgt_ids, [{E.EOS_ID}]), 1, {K.GEN_MAX_TARGET_LEN}) AS tg
        FROM enc))"""


# -- queries ----------------------------------------------------------------

@query("v01_vocabulary", S.with_(VOCAB_SQL) + "SELECT token, count, id FROM vocab")
def v01(spark, sf):
    return vocabulary(spark, sf)


@query("v02_encode", S.with_(ENC_SQL) + "SELECT pair_id, gen_prompt_ids, det_prompt_ids, tgt_ids FROM enc")
def v02(spark, sf):
    return encoded_pairs(spark, sf)


@query("v03_generation_examples", S.with_(GENEX_SQL) + "SELECT pair_id, input_ids, labels FROM genex")
def v03(spark, sf):
    return generation_examples(spark, sf)


@query("v04_padded_batches",
       S.with_(GENEX_SQL) + f""",
pos AS (SELECT *, row_number() OVER (ORDER BY {S.rkey('pair_id')}, pair_id) - 1 AS p FROM genex),
b AS (SELECT *, CAST(floor(p / {K.GEN_BATCH_SIZE}) AS BIGINT) AS batch_id FROM pos),
m AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS ml FROM b)
SELECT pair_id, batch_id,
       list_concat(list_transform(range(ml - len(input_ids)), lambda x: {E.PAD_ID}), input_ids) AS input_ids,
       list_concat(list_transform(range(ml - len(labels)), lambda x: {K.IGNORE_INDEX}), labels) AS labels,
       list_concat(list_transform(range(ml - len(input_ids)), lambda x: 0),
                   list_transform(range(len(input_ids)), lambda x: 1)) AS attention_mask
FROM m""")
def v04(spark, sf):
    g = random_positions(generation_examples(spark, sf), "pair_id", out="p")
    return E.pad_batches(g, "p").select("pair_id", F.col("batch_id").cast("bigint"),
                                        "input_ids", "labels", "attention_mask")


@query("v05_detection_encoding",
       S.with_(ENC_SQL) + f"""SELECT pair_id,
       list_concat(t, list_transform(range({K.DET_MAX_SEQ_LEN} - len(t)), lambda x: {E.PAD_ID})) AS input_ids,
       list_concat(list_transform(range(len(t)), lambda x: 1),
                   list_transform(range({K.DET_MAX_SEQ_LEN} - len(t)), lambda x: 0)) AS attention_mask
FROM (SELECT pair_id, list_slice(det_prompt_ids, 1, {K.DET_MAX_SEQ_LEN}) AS t FROM enc)""")
def v05(spark, sf):
    e = encoded_pairs(spark, sf)
    x = e.select("pair_id", V.fixed_length("det_prompt_ids", K.DET_MAX_SEQ_LEN, E.PAD_ID).alias("x"))
    return x.select("pair_id", "x.input_ids", "x.attention_mask")

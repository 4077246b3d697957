"""Registered scoring queries over embeddings: V6-V12 and F5."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.functions import arrays as V
from parallax.functions import text as T
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.registry import query

# Literal 2 x 8 classification head used to score 8-dim hidden states.
HEAD_W = [[0.5, -0.25, 0.125, 0.0, -0.5, 0.25, -0.125, 1.0],
          [0.3, 0.1, -0.2, 0.4, -0.1, 0.2, 0.05, -0.3]]
HEAD_B = [0.1, -0.1]


def hidden_states(spark, sf):
    """EMB as (T=8, H=8) hidden states with a right-padded mask of length vec_id % 8 + 1."""
    e = I.table(spark, sf, "embeddings")
    flat = F.transform("embedding", lambda x: x.cast("double"))
    n_real = (F.col("vec_id") % 8 + 1).cast("int")
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), 8 - n_real))
    return e.select("vec_id", V.reshape(flat, 8, 8).alias("hidden"), mask.alias("mask"),
                    (F.col("label") % 2).cast("int").alias("gold"))


def head_logits(spark, sf):
    h = hidden_states(spark, sf)
    return h.select("vec_id", "gold",
                    V.linear_head(V.last_real_vector("hidden", "mask"), HEAD_W, HEAD_B).alias("logits"))


HIDDEN_SQL = """hidden AS (
  SELECT vec_id, CAST(label % 2 AS INTEGER) AS gold,
         list_transform(range(0, 8), lambda t: list_transform(embedding[t * 8 + 1 : t * 8 + 8],
                                                              lambda x: CAST(x AS DOUBLE))) AS hidden,
         list_concat(list_transform(range(0, CAST(vec_id % 8 + 1 AS BIGINT)), lambda i: 1),
                     list_transform(range(0, CAST(7 - vec_id % 8 AS BIGINT)), lambda i: 0)) AS mask
  FROM embeddings)"""


def _sql_dot(row, h):
    terms = " + ".join(f"{float(w)!r} * {h}[{i + 1}]" for i, w in enumerate(row))
    return f"({terms})"


def _sql_sum(lst):
    return f"list_reduce({lst}, lambda a, b: a + b)"


LOGITS_SQL = HIDDEN_SQL + f""",
lastv AS (SELECT vec_id, gold, hidden[{_sql_sum('mask')}] AS h FROM hidden),
head AS (SELECT vec_id, gold, [{_sql_dot(HEAD_W[0], 'h')} + {HEAD_B[0]!r},
                               {_sql_dot(HEAD_W[1], 'h')} + {HEAD_B[1]!r}] AS logits FROM lastv)"""


def sql_softmax(z):
    e = f"list_transform({z}, lambda x: exp(x - list_max({z})))"
    return f"list_transform({e}, lambda x: x / {_sql_sum(e)})"


def sql_argmax(z):
    return f"CAST(list_position({z}, list_max({z})) - 1 AS INTEGER)"


def sql_logsumexp(z):
    return f"(list_max({z}) + ln({_sql_sum(f'list_transform({z}, lambda x: exp(x - list_max({z})))')}))"


@query("v06_last_real_position",
       S.with_(HIDDEN_SQL) + f"SELECT vec_id, CAST({_sql_sum('mask')} - 1 AS BIGINT) AS last_index, "
       f"hidden[{_sql_sum('mask')}] AS last_hidden FROM hidden")
def v06(spark, sf):
    h = hidden_states(spark, sf)
    return h.select("vec_id", V.last_real_index("mask").alias("last_index"),
                    V.last_real_vector("hidden", "mask").alias("last_hidden"))


@query("v07_linear_head", S.with_(LOGITS_SQL) + "SELECT vec_id, logits FROM head")
def v07(spark, sf):
    return head_logits(spark, sf).select("vec_id", "logits")


@query("v08_softmax",
       S.with_(S.emb_pred()) + f"""SELECT vec_id, i - 1 AS class_index, probs[i] AS prob
FROM (SELECT vec_id, probs, unnest(range(1, len(probs) + 1)) AS i
      FROM (SELECT vec_id, {sql_softmax('logits')} AS probs FROM emb_pred))""")
def v08(spark, sf):
    p = I.emb_predictions(spark, sf).select("vec_id", F.posexplode(V.softmax("logits")).alias("class_index", "prob"))
    return p.withColumn("class_index", F.col("class_index").cast("bigint"))


@query("v09_argmax",
       S.with_(S.emb_pred()) + f"SELECT vec_id, {sql_argmax('logits')} AS pred FROM emb_pred")
def v09(spark, sf):
    return I.emb_predictions(spark, sf).select("vec_id", V.argmax("logits").alias("pred"))


@query("v10_detection_result",
       S.with_(LOGITS_SQL) + f"""SELECT vec_id,
       CASE WHEN {sql_argmax('logits')} = 1 THEN 'correct' ELSE 'incorrect' END AS label,
       round(list_max({sql_softmax('logits')}), 4) AS confidence FROM head""")
def v10(spark, sf):
    r = head_logits(spark, sf).select("vec_id", V.detection_result("logits").alias("r"))
    return r.select("vec_id", "r.label", "r.confidence")


@query("v11_yes_no_decision",
       S.with_(S.emb_pred(binary=True)) + "SELECT vec_id, gold, "
       "CAST(logits[2] > logits[1] AS INTEGER) AS decision FROM emb_pred")
def v11(spark, sf):
    p = I.emb_predictions(spark, sf, binary=True)
    return p.select("vec_id", "gold", V.yes_no_decision("logits").alias("decision"))


@query("v12_cross_entropy",
       S.with_(S.emb_pred(), S.emb_pred(binary=True, name="emb_bin")[0:]) +
       f"""SELECT a.vec_id, {sql_logsumexp('a.logits')} - a.logits[a.gold + 1] AS ce,
       {sql_logsumexp('b.logits')} - b.logits[b.gold + 1] AS ce_binary
       FROM emb_pred a JOIN emb_bin b ON a.vec_id = b.vec_id""")
def v12(spark, sf):
    return I.emb_both_predictions(spark, sf).select(
        "vec_id", V.cross_entropy("logits", "gold").alias("ce"),
        V.cross_entropy("logits_binary", "gold_binary").alias("ce_binary"))


@query("f05_misclassified",
       S.with_(LOGITS_SQL) + f"""SELECT vec_id, gold_name AS gold, predicted, confidence FROM (
  SELECT vec_id, CASE WHEN gold = 1 THEN 'correct' ELSE 'incorrect' END AS gold_name,
         CASE WHEN {sql_argmax('logits')} = 1 THEN 'correct' ELSE 'incorrect' END AS predicted,
         round(list_max({sql_softmax('logits')}), 4) AS confidence
  FROM head) WHERE gold_name <> predicted""")
def f05(spark, sf):
    r = head_logits(spark, sf).select("vec_id", T.label_name("gold").alias("gold"),
                                      V.detection_result("logits").alias("r"))
    return (r.filter(F.col("gold") != F.col("r.label"))
            .select("vec_id", "gold", F.col("r.label").alias("predicted"), "r.confidence"))

"""Registered metric queries over predictions: A3-A6."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.operators import metrics as M
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.q_scoring import LOGITS_SQL, head_logits, sql_argmax
from parallax.functions import arrays as V
from parallax.plans.registry import query


def report_sql(src: str, names: dict | None = None) -> str:
    label = "CAST(cls AS VARCHAR)"
    if names:
        cases = " ".join(f"WHEN cls = {k} THEN '{v}'" for k, v in names.items())
        label = f"CASE {cases} ELSE CAST(cls AS VARCHAR) END"
    return f"""conf AS (SELECT gold, pred, count(*) AS n FROM {src} GROUP BY gold, pred),
per AS (
  SELECT cls, sum(gold_n) AS support, sum(pred_n) AS pred_n, sum(tp) AS tp FROM (
    SELECT gold AS cls, n AS gold_n, 0 AS pred_n, CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM conf
    UNION ALL SELECT pred, 0, n, 0 FROM conf) GROUP BY cls),
pr AS (
  SELECT cls, support, tp,
         CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                     ELSE 0.0 END AS f1 FROM pr)
SELECT {label} AS label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                 sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
                 CAST(sum(support) AS BIGINT) FROM f"""


HEAD_PRED = LOGITS_SQL + f""",
head_pred AS (SELECT vec_id, gold, {sql_argmax('logits')} AS pred FROM head)"""


def head_predictions(spark, sf):
    return head_logits(spark, sf).select("vec_id", "gold", V.argmax("logits").alias("pred"))


@query("a03_accuracy",
       S.with_(S.emb_pred(), S.emb_pred(True, "emb_bin")) +
       "SELECT avg(CAST(a.pred = a.gold AS DOUBLE)) AS accuracy, "
       "avg(CAST(b.pred = b.gold AS DOUBLE)) AS accuracy_binary "
       "FROM emb_pred a JOIN emb_bin b ON a.vec_id = b.vec_id")
def a03(spark, sf):
    return M.accuracy(I.emb_both_predictions(spark, sf), {"accuracy": ("gold", "pred"),
                                                          "accuracy_binary": ("gold_binary", "pred_binary")})


@query("a04_confusion_counts",
       S.with_(S.emb_pred()) + "SELECT gold, pred, count(*) AS n FROM emb_pred GROUP BY gold, pred")
def a04(spark, sf):
    return M.confusion_counts(I.emb_predictions(spark, sf))


@query("a04_false_positives_negatives",
       S.with_(HEAD_PRED) + """SELECT CAST(count(*) FILTER (WHERE gold = pred) AS BIGINT) AS correct,
       CAST(count(*) FILTER (WHERE pred = 1 AND gold <> 1) AS BIGINT) AS false_positives,
       CAST(count(*) FILTER (WHERE pred <> 1 AND gold = 1) AS BIGINT) AS false_negatives,
       count(*) AS total FROM head_pred""")
def a04b(spark, sf):
    return M.binary_error_counts(head_predictions(spark, sf))


@query("a05_classification_report", "WITH " + S.emb_pred() + ",\n" + report_sql("emb_pred"))
def a05(spark, sf):
    return M.classification_report(I.emb_predictions(spark, sf))


@query("a05_classification_report_binary",
       "WITH " + HEAD_PRED + ",\n" + report_sql("head_pred", {0: "incorrect", 1: "correct"}))
def a05b(spark, sf):
    return M.classification_report(head_predictions(spark, sf),
                                   class_names={0: "incorrect", 1: "correct"})


@query("a06_error_rate",
       S.with_(S.emb_pred()) + """SELECT CAST(count(*) FILTER (WHERE gold <> pred) AS BIGINT) AS errors,
       count(*) AS total, count(*) FILTER (WHERE gold <> pred) / count(*) * 100 AS error_pct
       FROM emb_pred""")
def a06(spark, sf):
    return M.error_rate(I.emb_predictions(spark, sf))

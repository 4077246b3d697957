"""Registered window queries: W1, W2 over EVT logs and W3-W6 over EMB candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax import constants as K
from parallax.operators import rerank as R
from parallax.operators import runs as W
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.registry import query


def _marks_sql(metric: str = "dev_loss", mode: str = "min") -> str:
    agg, start, cmp, pick = (("min", "'inf'::DOUBLE", "<", "least") if mode == "min"
                             else ("max", "0.0::DOUBLE", ">", "greatest"))
    return S.EVT_LOGS + f""",
b AS (SELECT *, {agg}({metric}) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM logs),
i AS (SELECT *, CAST(coalesce({metric} {cmp} coalesce(best_before, {start}), false) AS INTEGER) AS improved,
             {pick}(coalesce(best_before, {start}), {metric}) AS best_so_far FROM b),
l AS (SELECT *, max(CASE WHEN improved = 1 THEN epoch ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch
                 ROWS UNBOUNDED PRECEDING) AS last_improved FROM i),
c AS (SELECT *, epoch - last_improved AS no_improve,
             CAST(epoch - last_improved >= {K.PATIENCE} AS INTEGER) AS stop_hit FROM l),
marks AS (SELECT *, coalesce(max(stop_hit) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS kept FROM c)"""


def _best_sql(metric="dev_loss", mode="min") -> str:
    return S.with_(_marks_sql(metric, mode)) + """,
stops AS (SELECT run, min(epoch) AS stop_epoch FROM marks WHERE stop_hit = 1 GROUP BY run),
ends AS (SELECT run, max(epoch) AS last_epoch FROM marks GROUP BY run)
SELECT e.run, CAST(m.last_improved AS BIGINT) AS best_epoch, m.best_so_far AS best_value,
       CAST(s.stop_epoch AS BIGINT) AS stop_epoch, CAST(m.epoch AS BIGINT) AS epochs_run
FROM ends e LEFT JOIN stops s ON e.run = s.run
JOIN marks m ON m.run = e.run AND m.epoch = coalesce(s.stop_epoch, e.last_epoch)"""


def logs(spark, sf):
    return I.evt_logs(spark, sf)


@query("w01_best_checkpoint", _best_sql())
def w01(spark, sf):
    return W.best_checkpoint(logs(spark, sf))


@query("w01_best_checkpoint_accuracy", _best_sql("dev_acc", "max").replace(
    "value AS dev_loss", "value AS dev_acc"))
def w01_acc(spark, sf):
    return W.best_checkpoint(logs(spark, sf).withColumnRenamed("dev_loss", "dev_acc"),
                             metric="dev_acc", mode="max")


@query("w02_early_stopping",
       S.with_(_marks_sql()) + "SELECT run, epoch, improved, no_improve, kept FROM marks")
def w02(spark, sf):
    return W.early_stopping(logs(spark, sf))


# -- candidates -------------------------------------------------------------

SEEN_SQL = S.EMB_CAND + """,
seen AS (SELECT group_id + 1 AS group_id, candidate_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY logit DESC, candidate_id) AS r
  FROM emb_cand) WHERE r <= 3)"""

PENALIZED_SQL = SEEN_SQL + f""",
pen AS (SELECT c.group_id, c.candidate_id,
               CASE WHEN s.group_id IS NULL THEN c.logit
                    WHEN c.logit < 0 THEN c.logit * {K.REPETITION_PENALTY!r}
                    ELSE c.logit / {K.REPETITION_PENALTY!r} END AS logit
        FROM emb_cand c LEFT JOIN seen s ON c.group_id = s.group_id AND c.candidate_id = s.candidate_id)"""


def _softmax_sql(x: str) -> str:
    return (f"exp({x} - max({x}) OVER (PARTITION BY group_id)) / "
            f"sum(exp({x} - max({x}) OVER (PARTITION BY group_id))) OVER (PARTITION BY group_id)")


def _softmax_sql2(x: str, src: str, extra: str = "") -> str:
    return f"""(SELECT *, exp({x} - mx) / sum(exp({x} - mx)) OVER (PARTITION BY group_id) AS prob
  FROM (SELECT *, max({x}) OVER (PARTITION BY group_id) AS mx FROM {src}){extra})"""


def cands(spark, sf):
    return I.emb_candidates(spark, sf)


@query("w06_repetition_penalty",
       S.with_(PENALIZED_SQL) + "SELECT group_id, candidate_id, logit FROM pen")
def w06(spark, sf):
    c = cands(spark, sf)
    return R.repetition_penalty(c, R.previous_top(c))


@query("w03_temperature",
       S.with_(S.EMB_CAND) + ", t AS (SELECT *, logit / 0.7 AS x FROM emb_cand)\n"
       f"SELECT group_id, candidate_id, prob FROM {_softmax_sql2('x', 't')}")
def w03(spark, sf):
    return R.temperature(cands(spark, sf)).select("group_id", "candidate_id", "prob")


@query("w04_top_k",
       S.with_(S.EMB_CAND) + f"""SELECT group_id, candidate_id, rank FROM (
  SELECT group_id, candidate_id, row_number() OVER (PARTITION BY group_id ORDER BY logit DESC, candidate_id) AS rank
  FROM emb_cand) WHERE rank <= {K.TOP_K}""")
def w04(spark, sf):
    return R.top_k(cands(spark, sf)).select("group_id", "candidate_id", F.col("rank"))


TOPK_SQL = S.EMB_CAND + f""",
t AS (SELECT *, logit / 0.7 AS x FROM emb_cand),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY x DESC, candidate_id) AS rank
      FROM t) WHERE rank <= {K.TOP_K}),
kp AS {_softmax_sql2('x', 'k')},
nuc AS (SELECT * FROM (SELECT *, coalesce(sum(prob) OVER (PARTITION BY group_id ORDER BY prob DESC, candidate_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cb FROM kp) WHERE cb < {K.TOP_P!r})"""


@query("w05_nucleus",
       S.with_(TOPK_SQL) + "SELECT group_id, candidate_id, prob / sum(prob) OVER (PARTITION BY group_id) AS prob "
       "FROM nuc")
def w05(spark, sf):
    c = cands(spark, sf).withColumn("scaled", F.col("logit") / K.TEMPERATURE)
    c = R.temperature(R.top_k(c, K.TOP_K, "scaled"), 1.0, "scaled")
    return R.renormalize(R.nucleus(c)).select("group_id", "candidate_id", "prob")


def rerank_ctes() -> str:
    """Temperature > top-k > nucleus > cumulative probability and draw, over view ``pen``."""
    return f"""t AS (SELECT *, logit / 0.7 AS x FROM pen),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY x DESC, candidate_id) AS rank
      FROM t) WHERE rank <= {K.TOP_K}),
kp AS {_softmax_sql2('x', 'k')},
nuc AS (SELECT * FROM (SELECT *, coalesce(sum(prob) OVER (PARTITION BY group_id ORDER BY prob DESC, candidate_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cb FROM kp) WHERE cb < {K.TOP_P!r}),
np AS (SELECT group_id, candidate_id, prob / sum(prob) OVER (PARTITION BY group_id) AS p FROM nuc),
cum AS (SELECT *, sum(p) OVER (PARTITION BY group_id ORDER BY p DESC, candidate_id
               ROWS UNBOUNDED PRECEDING) AS cp,
               CAST(('0x' || substr({S.rkey('group_id')}, 1, 13))::BIGINT AS DOUBLE) / {float(16 ** 13)!r} AS u
        FROM np),
picked AS (SELECT group_id, arg_min(candidate_id, cp) AS candidate_id FROM cum WHERE cp > u GROUP BY group_id)"""


@query("w05_rerank_sample", S.with_(PENALIZED_SQL, rerank_ctes()) + "SELECT group_id, candidate_id FROM picked")
def w05_pick(spark, sf):
    c = cands(spark, sf)
    return R.rerank(c, R.previous_top(c))

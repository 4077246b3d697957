"""Registered feedback queries: S6, F6-F8, G8 and the batch form of ST2/ST3."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.operators import feedback as FB
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.q_sample import SPLIT, split_pairs
from parallax.plans.registry import query
from parallax.sources.io import load_feedback, scratch_path, written


def feedback(spark, sf):
    return load_feedback(I.evt_feedback(spark, sf))


FB_SQL = S.EVT_FEEDBACK + """,
fb AS (SELECT *, CAST(timestamp AS TIMESTAMPTZ) AS ts FROM feedback)"""

REASON_SQL = FB_SQL + """,
v AS (SELECT *, CASE
        WHEN user_label IS NULL OR user_label NOT IN ('correct', 'incorrect') THEN 'bad_label'
        WHEN user_rating IS NULL OR user_rating NOT BETWEEN 0 AND 5 THEN 'bad_rating'
        WHEN (user_label = 'incorrect' OR user_rating <= 2) AND coalesce(corrected_msa, '') = ''
          THEN 'missing_correction' END AS reason FROM fb),
r AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'quarantine'
                     WHEN coalesce(corrected_msa, '') <> '' THEN 'corrections'
                     WHEN user_rating >= 4 THEN 'high_quality' ELSE 'other' END AS route FROM v)"""


@query("s06_feedback_source",
       S.with_(FB_SQL) + "SELECT event_id, egyptian_arabic, generated_msa, user_label, user_rating, "
       "corrected_msa, timestamp, epoch_us(ts) AS ts_us FROM fb")
def s06(spark, sf):
    f = feedback(spark, sf)
    return f.select("event_id", "egyptian_arabic", "generated_msa", "user_label", "user_rating",
                    "corrected_msa", "timestamp", F.unix_micros("ts").alias("ts_us"))


@query("f06_high_quality_feedback",
       S.with_(FB_SQL) + "SELECT event_id, user_rating FROM fb WHERE user_rating >= 4")
def f06(spark, sf):
    return FB.high_quality(feedback(spark, sf)).select("event_id", "user_rating")


@query("f07_feedback_corrections",
       S.with_(FB_SQL) + "SELECT event_id, corrected_msa FROM fb WHERE coalesce(corrected_msa, '') <> ''")
def f07(spark, sf):
    return FB.corrections(feedback(spark, sf)).select("event_id", "corrected_msa")


@query("f08_feedback_validity", S.with_(REASON_SQL) + "SELECT event_id, reason, route FROM r")
def f08(spark, sf):
    return FB.route(feedback(spark, sf)).select("event_id", "reason", "route")


@query("st2_feedback_routes_batch",
       S.with_(REASON_SQL) + "SELECT event_id, egyptian_arabic, generated_msa, user_label, user_rating, "
       "corrected_msa, epoch_us(ts) AS ts_us, reason, route FROM r")
def st2(spark, sf):
    return FB.route(feedback(spark, sf)).select(
        "event_id", "egyptian_arabic", "generated_msa", "user_label", "user_rating", "corrected_msa",
        F.unix_micros("ts").alias("ts_us"), "reason", "route")


@query("st3_daily_feedback_batch",
       S.with_(FB_SQL) + f""",
d AS (SELECT DISTINCT {', '.join(FB.DEDUP_KEYS)}, (epoch_us(ts) // 86400000000) * 86400000000 AS day_start_us
      FROM fb)
SELECT day_start_us, count(*) AS n, avg(user_rating) AS mean_rating,
       avg(CAST(user_label = 'incorrect' AS DOUBLE)) AS incorrect_rate
FROM d GROUP BY day_start_us""")
def st3(spark, sf):
    s = FB.daily_feedback_stats(FB.dedup_daily(FB.with_day(feedback(spark, sf))))
    return s.select(F.unix_micros("day_start").alias("day_start_us"), "n", "mean_rating", "incorrect_rate")


G08_SQL = (
       S.with_(SPLIT.replace("WITH ", "") + ",\n" + REASON_SQL) + """,
cand AS (
  SELECT egyptian_arabic AS src, corrected_msa AS tgt, 1 AS prio, -epoch_us(ts) AS nts, -event_id AS nid,
         'correction' AS origin FROM r WHERE reason IS NULL AND coalesce(corrected_msa, '') <> ''
  UNION ALL
  SELECT egyptian_arabic, generated_msa, 2, -epoch_us(ts), -event_id, 'confirmed'
  FROM r WHERE reason IS NULL AND user_rating >= 4 AND user_label = 'correct'
  UNION ALL
  SELECT src, tgt, 3, 0, 0, 'train' FROM splits WHERE split = 'train')
SELECT src, tgt, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY prio, nts, nid, tgt, origin) AS rn FROM cand)
WHERE rn = 1""")


@query("g08_retraining_set", G08_SQL)
def g08(spark, sf):
    train = split_pairs(spark, sf).filter(F.col("split") == "train")
    return FB.retraining_set(train, feedback(spark, sf))


@query("g08_retraining_increments", G08_SQL)
def g08_increments(spark, sf):
    """The set as a table that takes the training pairs, then feedback by micro-batches: the
    second merge is given all batches and takes those it has not seen."""
    table = FB.RetrainingTable(spark, scratch_path(spark, "retraining"))
    table.merge_pairs(split_pairs(spark, sf).filter(F.col("split") == "train"))
    batched = written(feedback(spark, sf).withColumn("batch_id", F.col("event_id") % 4), "batches")
    table.merge_feedback(batched.where("batch_id < 2"))
    table.merge_feedback(batched)
    return table.rows()

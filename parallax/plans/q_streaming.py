"""The streams (ST1-ST3) as registered queries, and the batch twin of the request stream.

A stream query writes its table as files into the shared folder, runs the stream over
them until all are read, and returns what its sink committed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax import constants as K
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.q_models import LEXICON_SQL, _translate_sql, lexicon
from parallax.plans.q_feedback import FB_SQL, REASON_SQL
from parallax.plans.registry import ORACLE, query
from parallax.sources.io import scratch_path
from parallax.operators import feedback as FB
from parallax.streaming import streams as ST
from parallax.streaming.streams import answer_requests, prepare_requests


def _st1_sql() -> str:
    stripped = S.strip("coalesce(text, '')")
    clean = S.clean("s")
    req = f"""req AS (SELECT doc_id, s, CASE WHEN length(s) = 0 THEN {S.lit(K.EMPTY_INPUT_ERROR)} END AS error,
                {clean} AS src FROM (SELECT doc_id, {stripped} AS s FROM documents))"""
    prompt = S.template(K.GEN_PROMPT_QUOTED, slang="src")
    first = f"split_part(substring(({prompt} || tr), length({prompt}) + 1), chr(10), 1)"
    return S.with_(LEXICON_SQL + ",\n" + req + ",\n" + _translate_sql(
        "(SELECT * FROM req WHERE error IS NULL)", "doc_id", "src", "ans")) + f"""
SELECT r.doc_id, a.formal, r.error FROM req r
LEFT JOIN (SELECT doc_id, {S.strip(first)} AS formal FROM ans) a ON r.doc_id = a.doc_id"""


@query("st1_request_batch", _st1_sql())
def st1(spark, sf):
    req = I.table(spark, sf, "documents").select("doc_id", F.col("text").alias("slang"))
    return answer_requests(prepare_requests(req), "doc_id", lexicon(spark, sf))


def _ran(stream) -> None:
    """Wait for the stream's end; its failure is the query's."""
    stream.awaitTermination()


@query("st1_request_stream", _st1_sql())
def st1_stream(spark, sf):
    """The request stream over the documents as request files."""
    req = I.table(spark, sf, "documents").select("doc_id", F.col("text").alias("slang"))
    at = scratch_path(spark, "requests")
    # as many files as a stage has tasks; two micro-batches, whatever their number
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    req.repartition(files).write.parquet(f"{at}/in")
    _ran(ST.start_request_stream(spark, f"{at}/in", req.schema, "doc_id", lexicon(spark, sf), f"{at}/out",
                                 f"{at}/checkpoint", max_files_per_trigger=(files + 1) // 2))
    return spark.read.parquet(f"{at}/out").select("doc_id", "formal", "error")


def feedback_files(spark, sf, path: str, parts: int = 3):
    """The feedback table as files in the order of their times, as they would arrive."""
    fb = I.evt_feedback(spark, sf).drop("pair_key")
    ts = F.to_timestamp("timestamp")
    ends = fb.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    first, last = (F.unix_micros(F.lit(x)) for x in (ends["a"], ends["b"]))
    part = F.floor((F.unix_micros(ts) - first) * parts / (last - first + 1))
    for i in range(parts):
        fb.where(part == i).write.mode("append").parquet(path)
    return fb.schema


@query("st2_feedback_stream", ORACLE["st2_feedback_routes_batch"])
def st2_stream(spark, sf):
    """The feedback router, a micro-batch a file."""
    at = scratch_path(spark, "feedback")
    schema = feedback_files(spark, sf, f"{at}/in")
    _ran(ST.start_feedback_router(spark, f"{at}/in", schema, f"{at}/out", f"{at}/checkpoint", 4))
    return spark.read.parquet(f"{at}/out").select(
        "event_id", "egyptian_arabic", "generated_msa", "user_label", "user_rating", "corrected_msa",
        F.unix_micros("ts").alias("ts_us"), "reason", "route")


@query("st3_daily_stream",
       S.with_(FB_SQL) + f""",
d AS (SELECT DISTINCT {', '.join(FB.DEDUP_KEYS)}, (epoch_us(ts) // 86400000000) * 86400000000 AS day_start_us
      FROM fb),
s AS (SELECT day_start_us, count(*) AS n, avg(user_rating) AS mean_rating,
             avg(CAST(user_label = 'incorrect' AS DOUBLE)) AS incorrect_rate FROM d GROUP BY day_start_us)
SELECT * FROM s WHERE day_start_us <= (SELECT max(day_start_us) FROM s) - 86400000000""")
def st3_stream(spark, sf):
    """Daily figures with de-duplication state; a day comes out once the watermark, a day
    behind the latest, has reached it."""
    at = scratch_path(spark, "daily")
    schema = feedback_files(spark, sf, f"{at}/in")
    _ran(ST.start_daily_stats(spark, f"{at}/in", schema, f"{at}/out", f"{at}/checkpoint", max_files_per_trigger=4))
    return spark.read.parquet(f"{at}/out").select(
        F.unix_micros("day_start").alias("day_start_us"), "n", "mean_rating", "incorrect_rate")

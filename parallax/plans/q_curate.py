"""Registered curation queries: F1-F4, F9 and stage counts (A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import text as T
from parallax.operators import curate as C
from parallax.operators import positional as G
from parallax.operators.metrics import stage_counts
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.q_sample import CURATED, curated_pairs
from parallax.plans.jobs import write_curated_splits
from parallax.plans.registry import query
from parallax.sources.io import scratch_path

RAW_PAIRS = """raw_pairs AS (
  SELECT u.conv_id || ':' || u.turn AS pair_id, u.text AS src, a.text AS tgt
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


@query("f01_drop_missing",
       S.with_(RAW_PAIRS) + "SELECT pair_id, src, tgt FROM raw_pairs "
       "WHERE src IS NOT NULL AND tgt IS NOT NULL")
def f01(spark, sf):
    raw = C.pair_turns(I.table(spark, sf, "conversations"), how="left")
    return C.drop_missing(raw).select("pair_id", "src", "tgt")


@query("f02_drop_empty",
       S.with_(S.AR_DOCS) + f"SELECT doc_id, clean FROM (SELECT doc_id, {S.clean('text')} AS clean "
       "FROM ar_docs) WHERE length(clean) > 0")
def f02(spark, sf):
    d = C.evaluated_once(I.ar_documents(spark, sf), {"clean": T.clean_text("text")})
    return C.drop_empty(d, ["clean"]).select("doc_id", "clean")


@query("f03_flag_mostly_english",
       S.with_(CURATED) + "SELECT pair_id, src, tgt, mostly_english FROM curated")
def f03(spark, sf):
    return curated_pairs(spark, sf).select("pair_id", "src", "tgt", "mostly_english")


@query("f04_drop_mostly_english",
       S.with_(CURATED) + "SELECT pair_id, src, tgt, mostly_english FROM curated WHERE NOT mostly_english")
def f04(spark, sf):
    return C.drop_flagged(curated_pairs(spark, sf)).select("pair_id", "src", "tgt", "mostly_english")


@query("f09_validate_request",
       f"""SELECT doc_id, CASE WHEN length(s) > 0 THEN s END AS slang_clean,
       CASE WHEN length(s) = 0 THEN {S.lit(K.EMPTY_INPUT_ERROR)} END AS error
FROM (SELECT doc_id, {S.strip("coalesce(text, '')")} AS s FROM documents)""")
def f09(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.col("text").alias("slang"))
    return C.validate_request(d).select("doc_id", "slang_clean", "error")


A1_SQL = f"""WITH cur AS (
  SELECT doc_id, {S.mostly_english('t')} AS mostly_english
  FROM (SELECT doc_id, {S.clean('text')} AS t FROM documents WHERE text IS NOT NULL)
  WHERE length(t) > 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY {S.rkey('doc_id')}, doc_id) - 1 AS pos,
             count(*) OVER () AS n FROM cur),
s AS (SELECT *, n - CAST(ceil((1 - 0.8::DOUBLE) * n) AS BIGINT) AS n_train,
             CAST(ceil((1 - 0.8::DOUBLE) * n) AS BIGINT)
               - CAST(ceil(0.5::DOUBLE * ceil((1 - 0.8::DOUBLE) * n)) AS BIGINT) AS n_dev FROM r)
SELECT 'raw' AS stage, count(*) AS n FROM documents
UNION ALL SELECT 'cleaned', count(*) FROM cur
UNION ALL SELECT 'flagged', CAST(count(*) FILTER (WHERE mostly_english) AS BIGINT) FROM cur
UNION ALL SELECT CASE WHEN pos < n_train THEN 'train' WHEN pos < n_train + n_dev THEN 'dev'
                      ELSE 'test' END, count(*) FROM s GROUP BY 1"""


@query("a01_stage_counts", A1_SQL)
def a01(spark, sf):
    raw = I.table(spark, sf, "documents").select("doc_id", "text")
    cur = C.preprocess_pairs(raw, cols=["text"])
    return stage_counts(raw, G.split_dataset(cur, "doc_id"))


@query("a01_observed_counts", A1_SQL)
def a01_observed(spark, sf):
    """The counts as the job that cleans, splits and writes the documents observes them."""
    raw = I.table(spark, sf, "documents").select("doc_id", "text")
    return write_curated_splits(spark, raw, scratch_path(spark, "curated"), "doc_id", ["text"])[1]

"""Registered positional queries: G1-G5, J1, J4 and the flagship A2 slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.operators import curate as C
from parallax.operators import pairing as P
from parallax.operators import positional as G
from parallax.operators.metrics import dataset_statistics
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.registry import query


def curated_pairs(spark, sf):
    """CONV pairs > T6 > F2 > F3 (the curate stage of the minimum slice)."""
    return C.preprocess_pairs(I.conv_pairs(spark, sf))


def split_pairs(spark, sf):
    return G.split_dataset(curated_pairs(spark, sf), "pair_id")


# -- oracle views -----------------------------------------------------------

CURATED = S.CONV_PAIRS + f""",
curated AS (
  SELECT pair_id, conv_id, turn, src, tgt,
         {S.mostly_english('src')} OR {S.mostly_english('tgt')} AS mostly_english
  FROM (SELECT pair_id, conv_id, turn, {S.clean('src')} AS src, {S.clean('tgt')} AS tgt
        FROM conv_pairs WHERE src IS NOT NULL AND tgt IS NOT NULL)
  WHERE length(src) > 0 AND length(tgt) > 0)"""

SPLIT = CURATED + f""",
ranked AS (
  SELECT *, row_number() OVER (ORDER BY {S.rkey('pair_id')}, pair_id) - 1 AS pos,
         count(*) OVER () AS n
  FROM curated),
sized AS (
  SELECT *, n - CAST(ceil((1 - 0.8::DOUBLE) * n) AS BIGINT) AS n_train,
         CAST(ceil((1 - 0.8::DOUBLE) * n) AS BIGINT)
           - CAST(ceil(0.5::DOUBLE * ceil((1 - 0.8::DOUBLE) * n)) AS BIGINT) AS n_dev,
         CAST(ceil(0.5::DOUBLE * ceil((1 - 0.8::DOUBLE) * n)) AS BIGINT) AS n_test
  FROM ranked),
splits AS (
  SELECT pair_id, conv_id, turn, src, tgt, mostly_english,
         CASE WHEN pos < n_train THEN 'train' WHEN pos < n_train + n_dev THEN 'dev' ELSE 'test' END AS split,
         CASE WHEN pos < n_train THEN pos WHEN pos < n_train + n_dev THEN pos - n_train
              ELSE pos - n_train - n_dev END AS split_pos,
         CASE WHEN pos < n_train THEN n_train WHEN pos < n_train + n_dev THEN n_dev
              ELSE n_test END AS split_n
  FROM sized)"""

EXAMPLES = SPLIT + f""",
neg AS (
  SELECT a.split, a.pair_id AS src_pair_id, b.pair_id AS tgt_pair_id, a.src, b.tgt, 0 AS label
  FROM splits a JOIN splits b
    ON a.split = b.split AND b.split_pos = (a.split_pos + 1) % a.split_n
  WHERE a.split_n >= 2),
ex AS (
  SELECT split, pair_id AS src_pair_id, pair_id AS tgt_pair_id, src, tgt, 1 AS label FROM splits
  UNION ALL SELECT * FROM neg),
examples AS (
  SELECT *, src_pair_id || '/' || label AS example_id,
         row_number() OVER (PARTITION BY split
                            ORDER BY {S.rkey("src_pair_id || '/' || label")}, src_pair_id || '/' || label) - 1
           AS row_order
  FROM ex)"""


# -- queries ----------------------------------------------------------------

@query("j04_conversation_pairs", S.with_(S.CONV_PAIRS) + "SELECT * FROM conv_pairs")
def j04(spark, sf):
    return I.conv_pairs(spark, sf)


@query("g01_random_position",
       f"SELECT doc_id, row_number() OVER (ORDER BY {S.rkey('doc_id')}, doc_id) - 1 AS pos "
       "FROM documents")
def g01(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id")
    return G.random_positions(d, "doc_id")


@query("g02_split_dataset",
       S.with_(SPLIT) + "SELECT pair_id, split, split_pos, split_n, mostly_english FROM splits")
def g02(spark, sf):
    return split_pairs(spark, sf).select("pair_id", "split", "split_pos", "split_n",
                                         "mostly_english")


@query("g02_split_documents",
       f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {S.rkey('doc_id')}, doc_id) - 1 AS pos,
                      count(*) OVER () AS n FROM documents),
       s AS (SELECT *, n - CAST(ceil((1 - 0.8::DOUBLE) * n) AS BIGINT) AS n_train,
                   CAST(ceil((1 - 0.8::DOUBLE) * n) AS BIGINT)
                     - CAST(ceil(0.5::DOUBLE * ceil((1 - 0.8::DOUBLE) * n)) AS BIGINT) AS n_dev FROM r)
       SELECT CASE WHEN pos < n_train THEN 'train' WHEN pos < n_train + n_dev THEN 'dev'
                   ELSE 'test' END AS split, count(*) AS n
       FROM s GROUP BY 1""")
def g02_docs(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id")
    return G.split_dataset(d, "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("j01_mismatched_negatives",
       S.with_(SPLIT) + """SELECT a.split, a.pair_id AS src_pair_id, b.pair_id AS tgt_pair_id
  FROM splits a JOIN splits b ON a.split = b.split AND b.split_pos = (a.split_pos + 1) % a.split_n
  WHERE a.split_n >= 2""")
def j01(spark, sf):
    return P.mismatched_negatives(split_pairs(spark, sf)).select(
        "split", "src_pair_id", "tgt_pair_id")


@query("g03_shuffle_order", S.with_(EXAMPLES) + "SELECT split, example_id, row_order FROM examples")
def g03(spark, sf):
    return P.build_detection_examples(split_pairs(spark, sf)).select(
        "split", "example_id", "row_order")


@query("g04_union_examples",
       S.with_(EXAMPLES) + "SELECT split, src_pair_id, tgt_pair_id, src, tgt, CAST(label AS INTEGER) AS label FROM ex")
def g04(spark, sf):
    pairs = split_pairs(spark, sf)
    return P.union_examples(P.positives(pairs), P.mismatched_negatives(pairs)).select(
        "split", "src_pair_id", "tgt_pair_id", "src", "tgt", F.col("label").cast("int").alias("label"))


@query("g05_detection_examples",
       S.with_(EXAMPLES) + "SELECT split, example_id, src_pair_id, tgt_pair_id, src, tgt, "
       "CAST(label AS INTEGER) AS label, row_order FROM examples")
def g05(spark, sf):
    return P.build_detection_examples(split_pairs(spark, sf)).select(
        "split", "example_id", "src_pair_id", "tgt_pair_id", "src", "tgt",
        F.col("label").cast("int").alias("label"), "row_order")


A2_SQL = S.with_(EXAMPLES) + """SELECT coalesce(split, 'total') AS split,
       CAST(sum(CASE WHEN kind = 'generation' THEN 1 ELSE 0 END) AS BIGINT) AS generation_rows,
       CAST(sum(CASE WHEN kind = 'detection' THEN 1 ELSE 0 END) AS BIGINT) AS detection_rows
FROM (SELECT split, 'generation' AS kind FROM splits
      UNION ALL SELECT split, 'detection' AS kind FROM examples)
GROUP BY ROLLUP (split)"""


def flagship(spark, sf):
    """conversations > J4 > T6 > F2 > F3 > G2 > G5 > A2: rows per split and kind."""
    pairs = split_pairs(spark, sf)
    return dataset_statistics(pairs, P.build_detection_examples(pairs))


query("a02_dataset_statistics", A2_SQL)(flagship)


@query("j01_negatives_distinct_text",
       S.with_(SPLIT) + """,
lg AS (SELECT *, lag(tgt) OVER (PARTITION BY split ORDER BY split_pos) AS prev FROM splits),
isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> tgt THEN 1 ELSE 0 END)
                  OVER (PARTITION BY split ORDER BY split_pos ROWS UNBOUNDED PRECEDING) AS run FROM lg),
ends AS (SELECT split, run, max(split_pos) AS e FROM isl GROUP BY split, run),
x AS (SELECT i.*, ends.e FROM isl i JOIN ends ON i.split = ends.split AND i.run = ends.run),
fs AS (SELECT split, e AS first_end, tgt AS first_tgt FROM x WHERE split_pos = 0),
nr AS (SELECT split, max(run) AS nruns FROM isl GROUP BY split),
qq AS (SELECT x.split, x.pair_id AS src_pair_id,
              CASE WHEN x.e + 1 < x.split_n THEN x.e + 1 WHEN fs.first_tgt <> x.tgt THEN 0
                   WHEN nr.nruns > 1 THEN fs.first_end + 1 END AS q
       FROM x JOIN fs ON x.split = fs.split JOIN nr ON x.split = nr.split)
SELECT qq.split, qq.src_pair_id, b.pair_id AS tgt_pair_id
FROM qq JOIN splits b ON b.split = qq.split AND b.split_pos = qq.q""")
def j01_distinct(spark, sf):
    return P.mismatched_negatives(split_pairs(spark, sf), avoid_equal_text=True).select(
        "split", "src_pair_id", "tgt_pair_id")

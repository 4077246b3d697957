"""Inputs the registered queries derive from the driver tables.

Each is plain DataFrame code over the given parquet tables, mirrored by a
plain-SQL view in ``parallax.plans.oracle`` so DuckDB rebuilds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions import arrays as V
from parallax.functions import text as T
from parallax.operators.curate import pair_turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# CONV: user turn + following assistant turn.
def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_turns(table(spark, sf_dir, "conversations"))


# AR: documents transliterated onto Arabic code points.
def ar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.transliterate_to_arabic("text").alias("text"))


# EMB predictions: gold = label, logits = V7 head over all dimensions, pred = argmax.
DIMENSIONS = 64


def head_weights(classes: int) -> tuple[list[list[float]], list[float]]:
    """Literal weights and biases of the head, from a rule: small, different per class and dimension."""
    return ([[((31 * c + 17 * i + 5) % 23 - 11) / 16 for i in range(DIMENSIONS)] for c in range(classes)],
            [(c % 3 - 1) / 8 for c in range(classes)])


def emb_predictions(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    k = 2 if binary else 10
    emb = table(spark, sf_dir, "embeddings")
    logits = V.linear_head(F.transform("embedding", lambda x: x.cast("double")), *head_weights(k))
    gold = (F.col("label") % 2) if binary else F.col("label")
    # the one-row explode keeps the head from being evaluated again by each use of the logits
    out = emb.select("vec_id", gold.cast("int").alias("gold"), F.explode(F.array(logits)).alias("logits"))
    return out.withColumn("pred", V.argmax("logits"))


def emb_both_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views of each embedding in one row: (gold, logits, pred) of ten classes and of two."""
    emb = table(spark, sf_dir, "embeddings")
    h = F.transform("embedding", lambda x: x.cast("double"))
    out = emb.select("vec_id", F.col("label").cast("int").alias("gold"), (F.col("label") % 2).cast("int").alias("gold_binary"),
                     F.explode(F.array(F.struct(V.linear_head(h, *head_weights(10)).alias("ten"),
                                                V.linear_head(h, *head_weights(2)).alias("two")))).alias("z"))
    return out.select("vec_id", "gold", "gold_binary", F.col("z.ten").alias("logits"), F.col("z.two").alias("logits_binary"),
                      V.argmax("z.ten").alias("pred"), V.argmax("z.two").alias("pred_binary"))


# EMB candidates: one row per (group, candidate) from the embedding vector.
def emb_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("group_id"),
                      F.posexplode("embedding").alias("candidate_id", "logit")) \
        .select("group_id", F.col("candidate_id").cast("bigint"),
                F.col("logit").cast("double"))


# EVT feedback: six feedback columns derived from events.
def evt_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid, F.col("user_id").alias("pair_key"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("egyptian_arabic"),
        F.concat_ws(" ", "event_type", "props").alias("generated_msa"),
        F.when(eid % 3 == 0, "incorrect").otherwise("correct").alias("user_label"),
        (eid % 6).alias("user_rating"),
        F.when(eid % 4 == 0, F.concat(F.lit("fix "), eid.cast("string")))
         .otherwise("").alias("corrected_msa"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))


# EVT logs: run = user, epoch = order of (ts, event_id) inside the run.
def evt_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parallax.operators.positional import ordered_positions
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("dev_loss"))
    ev = ev.withColumn("_hour", F.date_trunc("hour", "ts"))
    numbered = ordered_positions(ev, [F.col("ts"), F.col("event_id")], ["_hour"],
                                 partition_cols=["run"], out="_p")
    return numbered.select("run", (F.col("_p") + 1).alias("epoch"), "dev_loss")

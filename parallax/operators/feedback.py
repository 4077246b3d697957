"""User-feedback curation (F6-F8, G8) shared by batch and streaming jobs.

Feedback rows: egyptian_arabic, generated_msa, user_label, user_rating,
corrected_msa, timestamp (ISO-8601 UTC string) [+ ts parsed].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.sources.io import written

FEEDBACK_COLUMNS = ("egyptian_arabic", "generated_msa", "user_label", "user_rating",
                    "corrected_msa", "timestamp")
HIGH_QUALITY_MIN_RATING = 4
LOW_RATING_MAX = 2


def with_event_time(df: DataFrame, col: str = "timestamp", out: str = "ts") -> DataFrame:
    """Parse the ISO-8601 UTC string into a timestamp column."""
    return df.withColumn(out, F.to_timestamp(F.col(col)))


def _has_correction() -> Column:
    return F.coalesce(F.col("corrected_msa"), F.lit("")) != ""


# F6
def high_quality(df: DataFrame) -> DataFrame:
    return df.filter(F.col("user_rating") >= HIGH_QUALITY_MIN_RATING)


# F7
def corrections(df: DataFrame) -> DataFrame:
    return df.filter(_has_correction())


# F8
def validity_reason(df: DataFrame) -> DataFrame:
    """``reason`` is null for a valid row, else the first broken rule."""
    label_ok = F.col("user_label").isin(K.LABEL_CORRECT, K.LABEL_INCORRECT)
    rating_ok = F.col("user_rating").between(0, 5)
    needs_fix = (F.col("user_label") == K.LABEL_INCORRECT) | (F.col("user_rating") <= LOW_RATING_MAX)
    reason = (F.when(~F.coalesce(label_ok, F.lit(False)), F.lit("bad_label"))
              .when(~F.coalesce(rating_ok, F.lit(False)), F.lit("bad_rating"))
              .when(needs_fix & ~_has_correction(), F.lit("missing_correction")))
    return df.withColumn("reason", reason)


def route(df: DataFrame) -> DataFrame:
    """Destination per row: quarantine (invalid), corrections, high_quality or other."""
    v = validity_reason(df)
    dest = (F.when(F.col("reason").isNotNull(), F.lit("quarantine"))
            .when(_has_correction(), F.lit("corrections"))
            .when(F.col("user_rating") >= HIGH_QUALITY_MIN_RATING, F.lit("high_quality"))
            .otherwise(F.lit("other")))
    return v.withColumn("route", dest)


# G8
def retraining_set(train_pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    """One (src, tgt) per source text: a valid correction beats a confirmed
    high-quality output, which beats the training pair; within a kind the
    latest feedback wins (then the larger id), of equal training sources
    the smallest target.
    """
    best = best_candidates(train_candidates(train_pairs).unionByName(feedback_candidates(feedback)))
    return best.select("src", "tgt", "origin")


CANDIDATE = ("prio", "nts", "nid", "tgt", "origin")  # the smallest wins


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The winning candidate per source, by a grouped min over an ordering struct, which
    combines map-side: a source repeated millions of times never lands whole in one task."""
    best = candidates.groupBy("src").agg(F.min(F.struct(*CANDIDATE)).alias("m"))
    return best.select("src", *[F.col(f"m.{c}").alias(c) for c in CANDIDATE])


def train_candidates(train_pairs: DataFrame) -> DataFrame:
    return train_pairs.select("src", F.lit(3).alias("prio"), F.lit(0).cast("bigint").alias("nts"),
                              F.lit(0).cast("bigint").alias("nid"), "tgt", F.lit("train").alias("origin"))


def feedback_candidates(feedback: DataFrame) -> DataFrame:
    fb = validity_reason(feedback).filter(F.col("reason").isNull())
    ts_us = F.coalesce(F.unix_micros(F.col("ts")), F.lit(0))
    order = [(-ts_us).alias("nts"), (-F.col("event_id")).alias("nid")]
    corr = corrections(fb).select(F.col("egyptian_arabic").alias("src"), F.lit(1).alias("prio"), *order,
                                  F.col("corrected_msa").alias("tgt"), F.lit("correction").alias("origin"))
    conf = high_quality(fb).filter(F.col("user_label") == K.LABEL_CORRECT).select(
        F.col("egyptian_arabic").alias("src"), F.lit(2).alias("prio"), *order,
        F.col("generated_msa").alias("tgt"), F.lit("confirmed").alias("origin"))
    return corr.unionByName(conf)


class RetrainingTable:
    """The retraining set as a table that grows by micro-batches of feedback.

    Below ``path`` stand the winning candidates by bucket of their source and a ledger of
    the micro-batches merged so far. A merge reads only batches that the ledger lacks,
    rewrites only buckets that one of their sources falls in, and enters them in the ledger
    last: a merge that broke off is done again from the start, and merging a candidate
    twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        """A part of the table; one that no merge has written yet is empty."""
        spark, path = self.spark, f"{self.path}/{name}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)

    def candidates(self) -> DataFrame:
        return self._read("best", "src string, prio int, nts bigint, nid bigint, tgt string, origin string, bucket int")

    def merged_batches(self) -> DataFrame:
        return self._read("ledger", "batch_id bigint").distinct()

    def rows(self) -> DataFrame:
        return self.candidates().select("src", "tgt", "origin")

    def _merge(self, fresh: DataFrame) -> int:
        """Buckets rewritten with the fresh candidates."""
        bucket = F.pmod(F.xxhash64("src"), F.lit(self.buckets)).cast("int")
        fresh = written(best_candidates(fresh).withColumn("bucket", bucket), "fresh")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return 0
        old = self.candidates().where(F.col("bucket").isin(touched))
        both = best_candidates(old.unionByName(fresh).drop("bucket")).withColumn("bucket", bucket)
        # written aside first: it is read from the folders that are about to be replaced
        both = written(both, "merged")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(
            f"{self.path}/best")
        return len(touched)

    def merge_pairs(self, train_pairs: DataFrame) -> int:
        """Training pairs, which are in no ledger: merging them again changes nothing."""
        return self._merge(train_candidates(train_pairs))

    def merge_feedback(self, feedback: DataFrame) -> tuple[int, int]:
        """Feedback rows with their ``batch_id`` > (batches merged, buckets rewritten)."""
        unseen = written(feedback.select("batch_id").distinct().join(self.merged_batches(), "batch_id", "left_anti"), "unseen")
        fresh = feedback.join(unseen, "batch_id", "left_semi")
        touched = self._merge(feedback_candidates(fresh))
        unseen.write.mode("append").parquet(f"{self.path}/ledger")
        return unseen.count(), touched


# ST3 (batch or stream)
def with_day(df: DataFrame, ts: str = "ts", out: str = "day") -> DataFrame:
    """UTC day of the event (tumbling 1-day window start, epoch aligned)."""
    return df.withColumn(out, F.window(ts, "1 day").start)


# A duplicate submission is the same content on the same UTC day.
DEDUP_KEYS = ["egyptian_arabic", "generated_msa", "user_label", "user_rating", "corrected_msa"]


def dedup_daily(df: DataFrame, day: str = "day") -> DataFrame:
    return df.dropDuplicates(DEDUP_KEYS + [day])


def daily_feedback_stats(df: DataFrame, day: str = "day") -> DataFrame:
    """Per UTC day: submissions, mean rating, share labelled incorrect."""
    return (df.groupBy(F.col(day).alias("day_start"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("user_rating").alias("mean_rating"),
                 F.avg((F.col("user_label") == K.LABEL_INCORRECT).cast("double")).alias("incorrect_rate")))

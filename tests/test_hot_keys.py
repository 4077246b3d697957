"""Hot keys: one source holding a third of the rows is combined map-side."""

from pyspark.sql import functions as F

from parallax.operators import feedback as FB


def test_retraining_set_hot_source(spark):
    n = 3000
    fb = spark.range(n).select(
        F.col("id").alias("event_id"), F.lit(0).alias("pair_key"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
        .alias("egyptian_arabic"),
        F.lit("gen").alias("generated_msa"), F.lit("correct").alias("user_label"),
        F.lit(5).cast("bigint").alias("user_rating"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("fix "), F.col("id").cast("string"))).otherwise(F.lit(""))
        .alias("corrected_msa"),
        F.lit("2024-01-01T00:00:00.000000Z").alias("timestamp"))
    fb = FB.with_event_time(fb)
    train = spark.createDataFrame([(1, "hot", "train target")], "pair_id long, src string, tgt string")
    out = FB.retraining_set(train, fb)
    rows = {r.src: r for r in out.collect()}
    # one row per source; the hot source keeps its correction with the largest id (same time)
    assert len(rows) == 1 + sum(1 for i in range(n) if i % 3 != 0)
    hot_fix = max(i for i in range(n) if i % 3 == 0 and i % 2 == 0)
    assert (rows["hot"].tgt, rows["hot"].origin) == (f"fix {hot_fix}", "correction")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan

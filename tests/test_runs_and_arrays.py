"""W1-W6 and V3-V12 goldens (FIXTURES.md 3.5-3.7)."""

import pytest
from pyspark.sql import functions as F

from parallax.functions import arrays as V
from parallax.operators import rerank as R
from parallax.operators import runs as W


def logs(spark, *runs):
    rows = [(r, e + 1, float(v)) for r, vals in enumerate(runs) for e, v in enumerate(vals)]
    return spark.createDataFrame(rows, "run long, epoch long, dev_loss double")


def test_best_checkpoint_goldens(spark):
    df = logs(spark, [3.0, 2.6, 2.39, 2.50, 2.74], [1.0, 0.9, 0.9, 0.95, 0.91, 0.5], [3, 2, 1])
    got = {r.run: (r.best_epoch, r.stop_epoch) for r in W.best_checkpoint(df).collect()}
    assert got == {0: (3, None), 1: (2, 5), 2: (3, None)}


def test_early_stopping_marks(spark):
    df = logs(spark, [1.0, 0.9, 0.9, 0.95, 0.91, 0.5])
    rows = W.early_stopping(df).orderBy("epoch").collect()
    assert [r.kept for r in rows] == [True] * 5 + [False]
    assert [r.no_improve for r in rows] == [0, 0, 1, 2, 3, 0]


def test_accuracy_mode_strict_improvement(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.5), (0, 3, 0.5)], "run long, epoch long, dev_acc double")
    r = W.best_checkpoint(df, "dev_acc", "max").first()
    assert (r.best_epoch, r.best_value) == (2, 0.5)


def test_scan_across_buckets(spark):
    # more epochs than one bucket: running min must carry across buckets
    vals = [float(10000 - i) if i < 1500 else 99999.0 for i in range(3000)]
    df = logs(spark, vals)
    r = W.best_checkpoint(df).first()
    assert (r.best_epoch, r.stop_epoch) == (1500, 1503)


def test_generation_example(spark):
    df = spark.createDataFrame([([1, 2, 3], [7, 8])], "p array<int>, t array<int>")
    x = df.select(V.generation_example("p", "t", 9, max_input=2).alias("x")).first().x
    assert (x.input_ids, x.labels) == ([2, 3, 7, 8, 9], [-100, -100, 7, 8, 9])


def test_padding_and_fixed_length(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    r = df.select(V.left_pad("ids", F.lit(5), 0).alias("a"), V.left_pad_mask("ids", F.lit(5)).alias("m")).first()
    assert (r.a, r.m) == ([0, 0, 1, 2, 3], [0, 0, 1, 1, 1])
    df = spark.createDataFrame([([5, 6],)], "ids array<int>")
    x = df.select(V.fixed_length("ids", 4).alias("x")).first().x
    assert (x.input_ids, x.attention_mask) == ([5, 6, 0, 0], [1, 1, 0, 0])
    assert df.select(V.last_real_index(F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(0))).alias("i")).first().i == 1


def test_softmax_argmax_ce(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    r = df.select(V.softmax("z").alias("p"), V.argmax("z").alias("a"), V.cross_entropy("z", F.lit(0)).alias("ce"),
                  V.yes_no_decision(F.array(F.lit(2.0), F.lit(2.0))).alias("d")).first()
    assert sum(r.p) == pytest.approx(1.0) and r.a == 1 and r.d == 0
    import math
    assert r.ce == pytest.approx(math.log(math.exp(1) + 2 * math.exp(3)) - 1)


def cands(spark, probs):
    import math
    return spark.createDataFrame([(0, i, math.log(p)) for i, p in enumerate(probs)],
                                 "group_id long, candidate_id long, logit double")


def test_top_k_and_nucleus(spark):
    c = R.temperature(cands(spark, [0.5, 0.3, 0.15, 0.05]), 1.0)
    assert R.top_k(c, 2).count() == 2
    assert R.nucleus(c, 0.92).count() == 3
    assert R.nucleus(c, 0.3).count() == 1


def test_repetition_penalty(spark):
    c = spark.createDataFrame([(0, 0, 2.6), (0, 1, -1.0), (0, 2, 0.5)], "group_id long, candidate_id long, logit double")
    seen = spark.createDataFrame([(0, 0), (0, 1)], "group_id long, candidate_id long")
    got = {r.candidate_id: r.logit for r in R.repetition_penalty(c, seen, 1.3).collect()}
    assert got == {0: pytest.approx(2.0), 1: pytest.approx(-1.3), 2: 0.5}


def test_rerank_picks_one_per_group(spark):
    c = spark.range(3 * 64).select((F.col("id") / 64).cast("long").alias("group_id"),
                                   (F.col("id") % 64).alias("candidate_id"),
                                   F.sin(F.col("id")).alias("logit"))
    out = R.rerank(c, R.previous_top(c)).collect()
    assert sorted(r.group_id for r in out) == [0, 1, 2]

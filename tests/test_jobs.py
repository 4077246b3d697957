"""End-to-end jobs write their stages and agree with the lazy queries."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from parallax.plans import inputs as I
from parallax.operators import curate as C
from parallax.operators import metrics as M
from parallax.operators import positional as G
from parallax.operators.pairing import align
from parallax.plans.jobs import (curate_file, evaluate_detection, evaluate_generation, prepare_corpus,
                                 write_curated_splits)
from parallax.sources.io import write_bucketed


def test_prepare_then_evaluate(spark, tmp_dir):
    raw = I.conv_pairs(spark, SF_SMALL).select("pair_id", "src", "tgt")
    out = prepare_corpus(spark, raw, tmp_dir)
    stats = sorted(tuple(r) for r in out["statistics"].collect())
    lazy = sorted(tuple(r) for r in E.entry(spark).collect())
    assert stats == lazy
    det = out["detection"]
    assert det.filter("label = 0 AND src_pair_id = tgt_pair_id").count() == 0
    ev = evaluate_generation(spark, out["generation"], tmp_dir + "/eval")
    n_test = out["generation"].filter(F.col("split") == "test").count()
    assert ev["scores"].count() == n_test
    assert 0.0 <= ev["corpus_chrf"].first().chrf <= 100.0
    assert ev["mean_median"].first().median is not None


def test_counts_are_observed_in_the_writing_job(spark, tmp_dir):
    """One read of the input, the counts of ``stage_counts``."""
    raw = I.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    _, counts = write_curated_splits(spark, raw.mapInArrow(counted, raw.schema), tmp_dir + "/splits", "doc_id", ["text"])
    assert reads.value == raw.count()
    want = M.stage_counts(raw, G.split_dataset(C.preprocess_pairs(raw, cols=["text"]), "doc_id"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))


def test_curate_from_a_path(spark, tmp_dir):
    path = tmp_dir + "/raw.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("formal_arabic,egyptian_arabic\n" + "".join(f"f{i},e {i}\n" for i in range(20)) + "NA,x\n")
    out = curate_file(spark, path, tmp_dir + "/out")
    counts = {r.stage: r.n for r in out["counts"].collect()}
    assert counts == {"raw": 21, "cleaned": 20, "flagged": 0, "train": 16, "dev": 2, "test": 2}
    assert out["detection"].count() == 40
    assert {(r.src[0], r.tgt[0]) for r in out["generation"].collect()} == {("e", "f")}


def test_detection_is_scored_once(spark, tmp_dir):
    """Errors, report and counts agree with the one table of predictions."""
    raw = I.conv_pairs(spark, SF_SMALL).select("pair_id", "src", "tgt")
    detection = prepare_corpus(spark, raw, tmp_dir)["detection"]
    out = evaluate_detection(spark, detection, tmp_dir + "/eval")
    rows = out["predictions"].collect()
    assert len(rows) == detection.where("split = 'test'").count() and len(rows) > 0
    wrong = {r.example_id for r in rows if r.gold != r.pred}
    assert {r.example_id for r in out["errors"].collect()} == wrong
    counts = out["counts"].first()
    assert counts.total == len(rows) and counts.false_positives + counts.false_negatives == len(wrong)
    report = {r.label: r for r in out["report"].collect()}
    assert report["correct"].support + report["incorrect"].support == len(rows)


def test_bucketed_tables_join_without_exchange(spark, tmp_dir):
    df = spark.range(2000).select(F.col("id").cast("string").alias("pair_id"), F.md5(F.col("id").cast("string")).alias("x"))
    one = write_bucketed(df, tmp_dir + "/one", "pair_id", 4)
    two = write_bucketed(df.withColumnRenamed("x", "y"), tmp_dir + "/two", "pair_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = align(one, two)
        assert joined.where("x = y").count() == 2000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        grouped = joined.groupBy("pair_id").count()
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

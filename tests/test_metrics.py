"""A3-A13 goldens (FIXTURES.md 3.4) and BLEU/chrF definitions."""

import pytest
from pyspark.sql import functions as F

from parallax.operators import metrics as M
from parallax.operators import overlap as O
from parallax.sources import io as IO


def pairs(spark, rows):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], "pair_id long, hyp string, ref string")


def test_chrf_golden(spark):
    df = pairs(spark, [("abc", "abd")])
    assert O.corpus_chrf(df).first().chrf == pytest.approx(38.8889, abs=1e-4)
    assert O.sentence_chrf(df).first().chrf == pytest.approx(38.8889, abs=1e-4)


def test_bleu_golden(spark):
    assert O.corpus_bleu(pairs(spark, [("a b c d", "a b c e")])).first().bleu == pytest.approx(59.4604, abs=1e-4)


def test_self_scores_are_100(spark):
    df = pairs(spark, [("the cat sat on the mat", "the cat sat on the mat")])
    assert O.corpus_bleu(df).first().bleu == pytest.approx(100.0)
    assert O.corpus_chrf(df).first().chrf == pytest.approx(100.0)


def test_bleu_zero_without_matches(spark):
    assert O.corpus_bleu(pairs(spark, [("x y z w", "a b c d")])).first().bleu == 0.0


def test_empty_rows_score_zero(spark):
    s = O.sentence_chrf(pairs(spark, [("", ""), ("abc", "abc")])).orderBy("pair_id").collect()
    assert [r.chrf for r in s] == [0.0, pytest.approx(100.0)]


def test_13a_tokens(spark):
    df = spark.createDataFrame([("Hello, world. It's 3.5-4 &amp; more!",)], "s string")
    toks = df.select(O.tokenize_13a("s").alias("t")).first().t
    assert toks == ["Hello", ",", "world", ".", "It's", "3.5", "-", "4", "&", "more", "!"]


def _preds(spark, tp, fn, tn, fp):
    rows = [(1, 1)] * tp + [(1, 0)] * fn + [(0, 0)] * tn + [(0, 1)] * fp
    return spark.createDataFrame(rows, "gold int, pred int")


def test_classification_report_golden(spark):
    rep = {r.label: r for r in M.classification_report(_preds(spark, 1767, 58, 1724, 101),
                                                       class_names={0: "incorrect", 1: "correct"}).collect()}
    assert rep["correct"].precision == pytest.approx(0.94593, abs=5e-6)
    assert rep["correct"].recall == pytest.approx(0.96822, abs=5e-6)
    assert rep["correct"].f1 == pytest.approx(0.95695, abs=5e-6)
    assert rep["incorrect"].precision == pytest.approx(0.96745, abs=5e-6)
    assert rep["incorrect"].recall == pytest.approx(0.94466, abs=5e-6)
    assert rep["incorrect"].f1 == pytest.approx(0.95592, abs=5e-6)
    assert rep["accuracy"].f1 == pytest.approx(0.95644, abs=5e-6)
    assert rep["accuracy"].support == 3650


def test_error_counts(spark):
    r = M.binary_error_counts(_preds(spark, 1767, 58, 1724, 101)).first()
    assert (r.correct, r.false_positives, r.false_negatives, r.total) == (3491, 101, 58, 3650)


def test_zero_denominator_gives_zero(spark):
    rep = {r.label: r for r in M.classification_report(_preds(spark, 0, 5, 5, 0)).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].f1 == 0.0


def test_median_even_and_odd(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 7.0]], "x double")
    r = M.mean_and_median(df, "x").first()
    assert (r.mean, r.median) == (3.0, 2.0)
    df = spark.createDataFrame([(v,) for v in [5.0, 1.0, 3.0, 10.5]], "x double")
    assert M.mean_and_median(df, "x").first().median == 4.0


def test_unpack_metrics_and_gain(spark):
    df = spark.createDataFrame([("Generation (Zero-shot)", "10.62 / 0.02 / 11851030.0"),
                                ("Detection (Zero-shot)", "0.5000")], "Task string, Value string")
    got = [r.value for r in IO.unpack_metrics(df, "Generation", ["chrf", "bleu", "ppl"]).orderBy("metric").collect()]
    assert got == [0.02, 10.62, 11851030.0]
    tidy = spark.createDataFrame([
        ("generation", "zero_shot", "chrf", 10.62), ("generation", "fine_tuned", "chrf", 29.08),
        ("generation", "zero_shot", "bleu", 0.02), ("generation", "fine_tuned", "bleu", 6.63),
        ("detection", "zero_shot", "accuracy", 0.5), ("detection", "fine_tuned", "accuracy", 0.956)],
        "task string, model string, metric string, value double")
    gains = {r.metric: r.gain for r in M.compare_models(tidy).collect()}
    assert gains == {"chrf": pytest.approx(18.46), "bleu": pytest.approx(6.61), "accuracy": pytest.approx(0.456)}
    pivot = {r.metric: r.gain for r in M.comparison_table(tidy).collect()}
    assert pivot == gains


def test_perplexity_and_batch_means(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1.0, 1.0, 1.0, 4.0])], "p long, row_loss double")
    assert M.perplexity(df).first().mean_loss == pytest.approx(1.75)
    # batches of 3: (1,1,1) and (4) -> mean of means 2.5
    assert M.mean_of_batch_means(df, "p", 3).first().loss == pytest.approx(2.5)


def test_chrf_of_repeated_keys_without_gram_rows(spark):
    """Rows of one key count as one text of both; a row with a null side counts not at all."""
    from collections import Counter
    rows = [("a", "abcab", "abxab"), ("a", "ab", "cab"), (None, "xy", "xyz"), (None, "yy", "y"), ("b", None, "abc"),
            ("c", "", "abc"), ("d", "  ", ""), ("b", "ab c", "abc"), ("e", "😀b" * 9, "b😀" * 7)]
    want = {}
    for key, hyp, ref in rows:
        if hyp is None:
            continue
        counts = want.setdefault(key, {n: (Counter(), Counter()) for n in range(1, O.CHRF_ORDER + 1)})
        for side, text in enumerate((hyp.replace(" ", ""), ref.replace(" ", ""))):
            for n, both in counts.items():
                both[side].update(text[i:i + n] for i in range(len(text) - n + 1))
    every = sorted((str(key), n, h.total() if r else 0, r.total(), sum(min(c, r[g]) for g, c in h.items()))
                   for key, counts in want.items() for n, (h, r) in [(0, (Counter(), Counter())), *counts.items()] if n == 0 or h or r)
    df = spark.createDataFrame(rows, "pair_id string, hyp string, ref string").repartition(3)
    assert sorted((str(r.pair_id), r.n, r.hyp, r.ref, r.match) for r in O.chrf_stats(df).collect()) == every
    scores = O.sentence_chrf(df)
    assert sorted(str(r.pair_id) for r in scores.collect()) == sorted(map(str, want))
    assert "Generate" not in scores._jdf.queryExecution().executedPlan().toString()

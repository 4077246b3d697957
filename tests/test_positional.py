"""G1-G5 and J1 invariants (FIXTURES.md 3.3, SURVEY section 5)."""

import pytest
from pyspark.sql import functions as F

from parallax.operators import pairing as P
from parallax.operators import positional as G


@pytest.mark.parametrize("n,expected", [(18250, (14600, 1825, 1825)), (536, (428, 54, 54)),
                                        (10, (8, 1, 1)), (15, (12, 1, 2)), (1005, (804, 100, 101))])
def test_split_sizes(n, expected):
    assert G.split_sizes(n) == expected


@pytest.mark.parametrize("n", [10, 15, 536, 1005])
def test_split_dataset_exact_and_disjoint(spark, n):
    df = spark.range(n).withColumnRenamed("id", "pair_id")
    s = G.split_dataset(df, "pair_id")
    counts = {r.split: r.c for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("c")).collect()}
    train, dev, test = G.split_sizes(n)
    assert counts == {k: v for k, v in {"train": train, "dev": dev, "test": test}.items() if v}
    assert s.select("pair_id").distinct().count() == n
    # split positions are a permutation 0..size-1 inside each split
    chk = s.groupBy("split").agg(F.min("split_pos").alias("lo"), F.max("split_pos").alias("hi"),
                                 F.countDistinct("split_pos").alias("d"), F.first("split_n").alias("n"))
    for r in chk.collect():
        assert (r.lo, r.hi, r.d) == (0, r.n - 1, r.n)


def test_random_positions_match_global_row_number(spark):
    import hashlib
    ids = list(range(2000))
    expected = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    df = spark.range(2000).withColumnRenamed("id", "k")
    got = {r.k: r.pos for r in G.random_positions(df, "k").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == expected


def test_split_rejects_bad_ratios(spark):
    with pytest.raises(ValueError):
        G.split_dataset(spark.range(3).withColumnRenamed("id", "pair_id"), "pair_id", (0.5, 0.3, 0.3))


def test_detection_examples_balanced_no_self_pairs(spark):
    n = 101
    df = spark.range(n).select(F.col("id").alias("pair_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("src"),
                               F.concat(F.lit("t"), F.col("id").cast("string")).alias("tgt"))
    ex = P.build_detection_examples(G.split_dataset(df, "pair_id")).cache()
    assert ex.count() == 2 * n
    assert ex.filter("label = 1").count() == n and ex.filter("label = 0").count() == n
    assert ex.filter("label = 0 AND src_pair_id = tgt_pair_id").count() == 0
    # every target is used exactly once as a negative within its split
    assert ex.filter("label = 0").select("tgt_pair_id").distinct().count() == n
    # row_order is a permutation inside each split
    chk = ex.groupBy("split").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("row_order").alias("d"),
                                  F.max("row_order").alias("m")).collect()
    for r in chk:
        assert r.c == r.d == r.m + 1


def test_single_row_split_has_no_negative(spark):
    df = spark.createDataFrame([(1, "a", "b", "dev", 0, 1)], "pair_id long, src string, tgt string, split string, split_pos long, split_n long")
    assert P.mismatched_negatives(df).count() == 0


def _brute_next_distinct(texts):
    n = len(texts)
    out = {}
    for p in range(n):
        for k in range(1, n):
            q = (p + k) % n
            if texts[q] != texts[p]:
                out[p] = q
                break
    return out


@pytest.mark.parametrize("texts", [
    ["a", "a", "b", "a", "a"],            # last run wraps past an equal first run
    ["a", "b", "b", "b", "c", "a", "a"],
    ["x", "x", "x"],                      # all equal: no negatives
    ["p", "q"],
])
def test_avoid_equal_text_matches_brute_force(spark, texts):
    n = len(texts)
    rows = [("train", p, n, 100 + p, f"s{p}", t) for p, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "split string, split_pos long, split_n long, pair_id long, src string, tgt string")
    got = {r.src_pair_id - 100: r.tgt_pair_id - 100
           for r in P.mismatched_negatives(df, avoid_equal_text=True).collect()}
    assert got == _brute_next_distinct(texts)


def test_avoid_equal_text_on_real_pairs(spark):
    from parallax.plans.q_sample import split_pairs
    from conftest import SF_SMALL
    s = split_pairs(spark, SF_SMALL)
    neg = P.mismatched_negatives(s, avoid_equal_text=True)
    pos_tgt = s.select(F.col("pair_id").alias("src_pair_id"), F.col("tgt").alias("own"))
    assert neg.join(pos_tgt, "src_pair_id").filter("tgt = own").count() == 0

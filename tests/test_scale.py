"""Keys, buckets and sinks that must hold at any size."""

import os

import pytest
from pyspark.sql import functions as F

from parallax.operators import curate as C
from parallax.operators import encode as E
from parallax.operators import overlap as O
from parallax.operators import positional as G
from parallax.session import checkpoint_dir
from parallax.sources import io as IO
from parallax.streaming import streams as ST


def test_pair_keys_of_long_conversations(spark):
    turns = spark.range(3 * 1500).select(
        (F.col("id") / 1500).cast("long").alias("conv_id"), (F.col("id") % 1500).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"))
    pairs = C.pair_turns(turns)
    assert pairs.count() == pairs.select("pair_id").distinct().count() == 3 * 750


def test_chrf_counts_code_points(spark):
    df = spark.createDataFrame([(1, "😀😁", "😀😂"), (2, "a😀b", "a😀b")], "pair_id long, hyp string, ref string")
    got = {r.pair_id: r.chrf for r in O.sentence_chrf(df).collect()}
    assert got[1] == pytest.approx(25.0) and got[2] == pytest.approx(100.0)
    grams = df.select(O.char_ngram_strings("hyp", 1).alias("g")).collect()
    assert [len(r.g) for r in grams] == [2, 3]


@pytest.mark.parametrize("n", [5_000, 50_000])
def test_order_buckets_are_few_and_even(spark, n):
    """Equal scores are split by id, one prefix shared by half the tokens by the rest."""
    same = spark.range(n).select(F.lit(0.0).alias("score"), F.col("id").cast("string").alias("key"))
    prefix = spark.range(n).select(F.lit(-1).alias("score"), F.when(F.col("id") % 2 == 0, F.concat(
        F.lit("al"), F.md5(F.col("id").cast("string")))).otherwise(F.md5(F.col("id").cast("string"))).alias("key"))
    for df in (same, prefix):
        sizes = [r["count"] for r in df.groupBy(G.order_bucket(df, ["score", "key"]).alias("b")).count().collect()]
        assert len(sizes) <= G.BUCKETS and max(sizes) <= 3 * n / len(sizes)
    got = G.sorted_positions(same, ["score", "key"]).orderBy("pos").select("pos", "key").collect()
    assert [r.key for r in got] == sorted(str(i) for i in range(n)) and [r.pos for r in got] == list(range(n))


def test_sorted_positions_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(2.0, "b"), (None, "a"), (2.0, "a"), (1.0, None)], "score double, key string")
    got = [(r.score, r.key) for r in G.sorted_positions(df, ["score", "key"]).orderBy("pos").collect()]
    assert got == [(None, "a"), (1.0, None), (2.0, "a"), (2.0, "b")]
    assert G.sorted_positions(df.limit(0), ["score", "key"]).collect() == []


def test_vocabulary_of_one_prefix(spark):
    words = " ".join(f"al{i:04d}" for i in range(3000))
    docs = spark.createDataFrame([(words,), ("al0007 al0003 al0003",)], "text string")
    ids = {r.token: r.id for r in E.build_vocabulary(docs).collect()}
    assert ids["al0003"] == E.FIRST_TOKEN_ID and ids["al0007"] == E.FIRST_TOKEN_ID + 1
    assert sorted(ids.values()) == list(range(E.FIRST_TOKEN_ID, E.FIRST_TOKEN_ID + 3000))


def test_row_keys_follow_content(spark):
    rows = [("a", "b")] * 70_000 + [("a", None), ("", "b"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "src string, tgt string").repartition(5)
    keyed = IO.with_row_key(df)
    assert keyed.count() == len(rows) == keyed.select("pair_id").distinct().count()
    assert keyed.groupBy("src", "tgt").count().count() == 4
    again = IO.with_row_key(df.repartition(3))
    assert keyed.select("pair_id").exceptAll(again.select("pair_id")).count() == 0


def test_replayed_batch_writes_its_rows_once(spark, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    for batch_id in (0, 1, 1):
        batch = spark.createDataFrame([(batch_id, "x"), (batch_id + 10, "y")], "id long, route string")
        ST.write_batch(batch, out, batch_id, "route")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 10, 11]


def test_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_constants_are_encoded_like_any_word(spark):
    """Template words ride with the row; ids and order are those of the join."""
    vocab = spark.createDataFrame([(w, 1, i + 3) for i, w in enumerate("say the word now again".split())],
                                  "token string, count long, id long")
    rows = spark.createDataFrame([(1, "say the word now", "the x again"), (2, "say now", ""), (3, None, "x"), (4, "", None)],
                                 "k long, a string, b string")
    plain = E.encode(rows, "k", ["a", "b"], vocab).orderBy("k").collect()
    assert plain == E.encode(rows, "k", ["a", "b"], vocab, constants=["say", "now", "absent"]).orderBy("k").collect()
    assert [tuple(r) for r in plain] == [(1, [3, 4, 5, 6], [4, E.UNK_ID, 7]), (2, [3, 6], []), (3, [], [E.UNK_ID]), (4, [], [])]

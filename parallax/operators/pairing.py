"""Detection examples: positives, mismatched negatives, union, shuffle
(J1, G4, G5) and hypothesis/reference alignment (J2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.operators.positional import shuffle_order

# Buckets a split is cut into for running sums: the carry has at most as many rows per split.
CARRY_ROWS = 1024


# J1
def mismatched_negatives(pairs: DataFrame, avoid_equal_text: bool = False) -> DataFrame:
    """Label-0 rows: each source gets the target of the next row in the
    split's random order (cyclic), so no row is paired with itself.

    Needs ``split``, ``split_pos``, ``split_n`` from G2. One equi-join on
    (split, position): keys are unique, so there is no skew. A split with a
    single row has no other target and yields no negative.

    With ``avoid_equal_text`` a row whose next target has the same text
    takes the first following target (cyclically) with a different text, so
    duplicated targets never give a false negative; a split whose targets
    are all equal yields none.
    """
    if avoid_equal_text:
        return _negatives_with_distinct_text(pairs)
    a = (pairs.filter(F.col("split_n") >= 2)
         .select("split", ((F.col("split_pos") + 1) % F.col("split_n")).alias("_k"),
                 F.col("pair_id").alias("src_pair_id"), "src"))
    b = pairs.select(F.col("split").alias("_s"), F.col("split_pos").alias("_p"),
                     F.col("pair_id").alias("tgt_pair_id"), "tgt")
    return (a.join(b, (a.split == b._s) & (a._k == b._p))
            .select("split", "src_pair_id", "tgt_pair_id", "src", "tgt",
                    F.lit(0).alias("label")))


def _negatives_with_distinct_text(pairs: DataFrame) -> DataFrame:
    """Next position with a different target text = end of the row's run of
    equal consecutive texts + 1 (runs found with a bucketed prefix sum, so
    no split is processed by one task); the last run wraps to the start."""
    from parallax.operators.scan import prefix_scan
    p = pairs.select("split", "split_pos", "split_n", "pair_id", "src", "tgt")
    prev = p.select(F.col("split").alias("_s"), (F.col("split_pos") + 1).alias("_k"),
                    F.col("tgt").alias("_prev"))
    x = p.join(prev, (p.split == prev._s) & (p.split_pos == prev._k), "left").drop("_s", "_k")
    x = x.withColumn("_start", (F.col("_prev").isNull() | (F.col("_prev") != F.col("tgt"))).cast("int"))
    x = x.withColumn("_b", F.floor(F.col("split_pos") * CARRY_ROWS / F.col("split_n")))
    x = prefix_scan(x, F.col("_start"), "sum", "_run", ["split"], [F.col("split_pos")], "_b")
    runs = x.groupBy("split", "_run").agg(F.max("split_pos").alias("_end"))
    x = x.join(runs, ["split", "_run"])
    # Per split (one row each): end of the first run, number of runs, first text.
    first = x.filter(F.col("split_pos") == 0).select(
        F.col("split").alias("_fs"), F.col("_end").alias("_first_end"), F.col("tgt").alias("_first_tgt"))
    nruns = runs.groupBy(F.col("split").alias("_ns")).agg(F.max("_run").alias("_nruns"))
    x = (x.join(first, x.split == first._fs).join(nruns, x.split == nruns._ns)
         .drop("_fs", "_ns"))
    nxt = F.col("_end") + 1
    q = (F.when(nxt < F.col("split_n"), nxt)
         .when(F.col("_first_tgt") != F.col("tgt"), F.lit(0))
         .when(F.col("_nruns") > 1, F.col("_first_end") + 1))
    a = x.select("split", q.alias("_q"), F.col("pair_id").alias("src_pair_id"), "src").filter(
        F.col("_q").isNotNull())
    b = p.select(F.col("split").alias("_s"), F.col("split_pos").alias("_p"),
                 F.col("pair_id").alias("tgt_pair_id"), "tgt")
    return (a.join(b, (a.split == b._s) & (a._q == b._p))
            .select("split", "src_pair_id", "tgt_pair_id", "src", "tgt", F.lit(0).alias("label")))


def positives(pairs: DataFrame) -> DataFrame:
    return pairs.select("split", F.col("pair_id").alias("src_pair_id"),
                        F.col("pair_id").alias("tgt_pair_id"), "src", "tgt",
                        F.lit(1).alias("label"))


# G4
def union_examples(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.unionByName(neg)


# G5
def build_detection_examples(pairs: DataFrame, seed: int = K.SEED,
                             avoid_equal_text: bool = False) -> DataFrame:
    """Balanced examples per split: positives + J1 negatives, with a seeded
    shuffled ``row_order`` inside each split (G3)."""
    ex = union_examples(positives(pairs), mismatched_negatives(pairs, avoid_equal_text))
    ex = ex.withColumn("example_id", F.concat(F.col("src_pair_id").cast("string"), F.lit("/"), F.col("label").cast("string")))
    return shuffle_order(ex, "example_id", seed, partition_cols=["split"])


# J2
def align(hyp: DataFrame, ref: DataFrame, key: str = "pair_id") -> DataFrame:
    """Hypothesis <-> reference by key (never by position)."""
    return hyp.join(ref, key)

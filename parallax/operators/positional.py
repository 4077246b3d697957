"""Global row positions without a single-partition window.

A global ``row_number() over (order by k)`` funnels every row through one
task. Here the order is cut into coarse, order-preserving buckets:

1. rows are hash-partitioned by (group, bucket) and numbered inside their
   bucket (many tasks in parallel);
2. the per-bucket counts form a table with one row per bucket, whose running
   sum gives each bucket's starting offset;
3. the offsets are joined back (broadcast when the bucket count is bounded).

The count table is derived from the same exchange as the numbered rows, so
Spark reuses that shuffle instead of scanning the input twice.

Where the order has no such buckets of its own, one range exchange makes them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.sources.io import written


def ordered_positions(df: DataFrame, order_by: Sequence[Column], bucket_cols: Sequence[str],
                      partition_cols: Sequence[str] = (), out: str = "pos",
                      size_col: str | None = None, bucket_order: Sequence[Column] | None = None,
                      broadcast_offsets: bool = False, weight_col: str | None = None) -> DataFrame:
    """0-based dense position of each row in ``order_by`` within ``partition_cols``.

    ``bucket_cols`` must be a monotone coarsening of ``order_by`` (rows in an
    earlier bucket sort before rows of a later one); ``bucket_order`` gives
    the bucket sort direction (ascending by default).
    ``broadcast_offsets`` is only for a proven bound on buckets x groups.
    With ``weight_col`` each row counts as that many rows and the result is
    the exclusive running sum of weights (the row's starting position).
    """
    parts = list(partition_cols)
    keys = parts + list(bucket_cols)
    border = list(bucket_order) if bucket_order else [F.col(c) for c in bucket_cols]

    inner = Window.partitionBy(*keys).orderBy(*order_by)
    if weight_col:
        run = F.sum(weight_col).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        run = F.row_number().over(inner)
    ranked = df.withColumn("_rn", run)
    counts = ranked.groupBy(*keys).agg(F.max("_rn").alias("_cnt"))
    before = (Window.partitionBy(*parts) if parts else Window).orderBy(*border) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if size_col:
        whole = Window.partitionBy(*parts) if parts else Window.partitionBy()
        offsets = offsets.withColumn(size_col, F.sum("_cnt").over(whole))
    offsets = offsets.drop("_cnt")
    # Null-safe keys: no inferred isnotnull filter lands on one branch only,
    # so both branches keep the same exchange and Spark reuses it.
    renamed = [f"_k{i}" for i in range(len(keys))]
    offsets = offsets.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)],
                             "_off", *([size_col] if size_col else []))
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    cond = [ranked[k].eqNullSafe(offsets[r]) for k, r in zip(keys, renamed)]
    return (ranked.join(offsets, cond)
            .withColumn(out, F.col("_off") + F.col("_rn")
                        - (F.col(weight_col) if weight_col else F.lit(1)))
            .drop("_rn", "_off", *renamed))


# At most this many buckets, whatever the data; and rows the bounds are picked from.
BUCKETS = 64
BOUND_SAMPLE = 64 * BUCKETS


def order_bucket(df: DataFrame, order_by: Sequence[str], buckets: int = BUCKETS,
                 sample: int = BOUND_SAMPLE) -> Column:
    """A bucket number that follows the ascending order of the columns.

    Bounds are quantiles of the ``sample`` rows with the smallest hash, a bounded
    number; a row's bucket is how many bounds lie below it. Bounds only place
    rows: all are numbered, and rows with equal leading columns are split by the
    following ones. The last column should tell rows apart.
    """
    rows = (df.select(*order_by).orderBy(F.xxhash64(*order_by), *order_by).limit(sample)
            .orderBy(*order_by).collect())
    picked = sorted({len(rows) * i // buckets for i in range(1, buckets)} if rows else ())
    own = F.struct(*[F.col(c) for c in order_by])
    kinds = [df.schema[c].dataType for c in order_by]
    bounds = [F.struct(*[F.lit(rows[i][c]).cast(k).alias(c) for c, k in zip(order_by, kinds)]) for i in picked]
    return sum(((b < own).cast("int") for b in bounds), F.lit(0))


IN_PARTITION = (1 << 33) - 1  # the bits of a monotonically increasing id below its partition's number


def sorted_positions(df: DataFrame, order_by: Sequence[str], out: str = "pos", weight_col: str | None = None,
                     size_col: str | None = None) -> DataFrame:
    """0-based position of each row in the ascending order of columns.

    Rows go through one range exchange, are sorted and numbered within their partitions
    and written to the shared folder with these numbers; what precedes a partition is
    added from a table with one row per partition. With ``weight_col`` (see
    ``ordered_positions``) rows are numbered in at most ``BUCKETS`` buckets; df is then read
    twice: a costly one should be written first."""
    if weight_col:
        bucketed = df.withColumn("_ob", order_bucket(df, order_by))
        return ordered_positions(bucketed, [F.col(c) for c in order_by], ["_ob"], out=out, weight_col=weight_col,
                                 size_col=size_col).drop("_ob")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in order_by]
    numbered = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .withColumn("_id", F.monotonically_increasing_id()), "sorted")
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                           *([F.sum("_n").over(Window.partitionBy()).alias(size_col)] if size_col else []))
    return (numbered.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_off") + F.col("_id").bitwiseAND(F.lit(IN_PARTITION))).drop("_id", "_part", "_off"))


# G1 ------------------------------------------------------------------------

def random_key(id_col: str, seed: int = K.SEED) -> Column:
    """Seeded uniform order key: md5 of '<seed>:<id>' (same in Spark and SQL)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def random_positions(df: DataFrame, id_col: str, seed: int = K.SEED,
                     partition_cols: Sequence[str] = (), out: str = "pos",
                     size_col: str | None = None, bucket_chars: int = 4,
                     few_groups: bool = False) -> DataFrame:
    """Seeded random permutation position (0-based) of each row.

    Buckets are the first ``bucket_chars`` hex digits of the md5 key, so at
    most 16**bucket_chars buckets per group, each holding a uniform slice of
    the rows (the key is a hash, so no bucket is hot). Spark picks the join with
    the offset table by its size; ``few_groups`` (a known small number) asks
    for a broadcast.
    """
    keyed = (df.withColumn("_h", random_key(id_col, seed))
               .withColumn("_b", F.substring("_h", 1, bucket_chars)))
    res = ordered_positions(keyed, [F.col("_h"), F.col(id_col)], ["_b"], partition_cols,
                            out=out, size_col=size_col, broadcast_offsets=few_groups)
    return res.drop("_h", "_b")


# G2 ------------------------------------------------------------------------

def split_sizes(n: int, ratios: Sequence[float] = K.SPLIT_RATIOS) -> tuple[int, int, int]:
    """Exact split sizes for ``n`` rows (plain Python, for checks and docs)."""
    train, dev, test = ratios
    n_temp = math.ceil((1 - train) * n)
    n_test = math.ceil(test / (dev + test) * n_temp)
    return n - n_temp, n_temp - n_test, n_test


def split_dataset(df: DataFrame, id_col: str, ratios: Sequence[float] = K.SPLIT_RATIOS,
                  seed: int = K.SEED) -> DataFrame:
    """Disjoint train/dev/test split of exact sizes.

    Adds ``split``, ``split_pos`` (0-based random position inside the split)
    and ``split_n`` (split size). Sizes: temp = ceil((1-train)*n),
    test = ceil(test/(dev+test) * temp), dev = temp - test, train = n - temp.
    """
    train, dev, test = ratios
    if abs(train + dev + test - 1.0) >= 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {ratios}")
    rel_test = test / (dev + test)
    pos = random_positions(df, id_col, seed, size_col="_n")
    n = F.col("_n")
    n_temp = F.ceil(F.lit(1 - train) * n)
    n_test = F.ceil(F.lit(rel_test) * n_temp)
    n_train = n - n_temp
    n_dev = n_temp - n_test
    p = F.col("pos")
    return (pos
            .withColumn("split", F.when(p < n_train, "train")
                        .when(p < n_train + n_dev, "dev").otherwise("test"))
            .withColumn("split_pos", F.when(p < n_train, p)
                        .when(p < n_train + n_dev, p - n_train).otherwise(p - n_train - n_dev))
            .withColumn("split_n", F.when(p < n_train, n_train)
                        .when(p < n_train + n_dev, n_dev).otherwise(n_test))
            .drop("_n", "pos"))


# G3 ------------------------------------------------------------------------

def shuffle_order(df: DataFrame, id_col: str, seed: int = K.SEED,
                  partition_cols: Sequence[str] = (), out: str = "row_order") -> DataFrame:
    """Shuffled order as a column; rows are physically sorted only on export."""
    return random_positions(df, id_col, seed, partition_cols, out=out)

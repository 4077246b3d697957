"""Running (prefix) min / max / sum inside a group, split into buckets.

A plain ``Window.partitionBy(g).orderBy(t)`` sends a whole group to one
task; a group holding a third of the rows would stall the stage. Here the
order is cut into buckets (a monotone coarsening of the order, e.g.
``floor(epoch / 1024)``):

1. running value inside each (group, bucket) - many tasks;
2. one total per (group, bucket), whose running value across earlier
   buckets is the carry (a table with one row per bucket);
3. carry joined back and combined with the in-bucket value.

As in ``positional``, the bucket totals come off the same exchange as the
in-bucket window, so the input is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"min": F.min, "max": F.max, "sum": F.sum}


def _combine(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    # least/greatest skip nulls, so an empty side simply drops out.
    return F.least(carry, local) if op == "min" else F.greatest(carry, local)


def prefix_scan(df: DataFrame, value: Column, op: str, out: str,
                partition_cols: Sequence[str], order_by: Sequence[Column], bucket_col: str,
                inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running ``op`` of ``value`` over rows up to (inclusive)
    or before (exclusive) the current one, within ``partition_cols``."""
    agg = _AGG[op]
    parts = list(partition_cols)
    keys = parts + [bucket_col]
    inner = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = df.withColumn("_v", value).withColumn("_local", agg("_v").over(inner))
    totals = local.groupBy(*keys).agg(agg("_v").alias("_bt"))
    before = Window.partitionBy(*parts).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", agg("_bt").over(before))
    renamed = [f"_k{i}" for i in range(len(keys))]
    carry = carry.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], "_carry")
    cond = [local[k].eqNullSafe(carry[r]) for k, r in zip(keys, renamed)]
    res = local.join(carry, cond).withColumn(out, _combine(op, F.col("_carry"), F.col("_local")))
    return res.drop("_v", "_local", "_carry", *renamed)

"""Checkpoint selection over run logs.

Log table: (run, epoch, <metric>), epochs dense 1..E per run. Semantics of
the training loops: an epoch improves when its metric strictly beats the
best so far (loss starts at +inf, accuracy at 0.0; the first of equal
values wins). A non-improving epoch increments a counter that improvement
resets; training stops at the first epoch where the counter reaches
``patience``. The saved checkpoint is the last improvement up to the stop.

Everything is prefix scans over (run, epoch) plus one aggregation per run,
so no run is ever processed by a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.operators.scan import prefix_scan

EPOCH_BUCKET = 1024


def _scan(df, value, op, out, inclusive):
    return prefix_scan(df, value, op, out, ["run"], [F.col("epoch")], "_eb", inclusive)


def mark_epochs(logs: DataFrame, metric: str = "dev_loss", mode: str = "min",
                patience: int = K.PATIENCE) -> DataFrame:
    """Per epoch: best_before, improved, no_improve, stop_hit, kept (W2 marks)."""
    lower = mode == "min"
    start = float("inf") if lower else 0.0
    df = logs.withColumn("_eb", F.floor((F.col("epoch") - 1) / EPOCH_BUCKET))
    df = _scan(df, F.col(metric), "min" if lower else "max", "best_before", inclusive=False)
    best = F.coalesce(F.col("best_before"), F.lit(start))
    better = F.col(metric) < best if lower else F.col(metric) > best
    df = df.withColumn("improved", F.coalesce(better, F.lit(False)).cast("int"))
    df = df.withColumn("best_so_far", (F.least if lower else F.greatest)(best, F.col(metric)))
    df = _scan(df, F.when(F.col("improved") == 1, F.col("epoch")).otherwise(0), "max",
               "last_improved", inclusive=True)
    df = df.withColumn("no_improve", F.col("epoch") - F.col("last_improved"))
    df = df.withColumn("stop_hit", (F.col("no_improve") >= patience).cast("int"))
    df = _scan(df, F.col("stop_hit"), "max", "_stopped_before", inclusive=False)
    return (df.withColumn("kept", F.coalesce(F.col("_stopped_before"), F.lit(0)) == 0)
              .drop("_eb", "_stopped_before"))


def early_stopping(logs: DataFrame, metric: str = "dev_loss", mode: str = "min",
                   patience: int = K.PATIENCE) -> DataFrame:
    """(run, epoch, improved, no_improve, kept)."""
    return mark_epochs(logs, metric, mode, patience).select(
        "run", "epoch", "improved", "no_improve", "kept")


def best_checkpoint(logs: DataFrame, metric: str = "dev_loss", mode: str = "min",
                    patience: int = K.PATIENCE) -> DataFrame:
    """W1 (+ W2 stop): per run the saved epoch, its metric, the stop epoch
    (null when patience never ran out) and the number of epochs run."""
    m = mark_epochs(logs, metric, mode, patience)
    at = F.struct("epoch", "last_improved", "best_so_far")
    summary = m.groupBy("run").agg(
        F.min(F.when(F.col("stop_hit") == 1, at)).alias("_stop"),
        F.max(at).alias("_last"))
    chosen = F.coalesce(F.col("_stop"), F.col("_last"))
    return summary.select(
        "run",
        chosen["last_improved"].cast("bigint").alias("best_epoch"),
        chosen["best_so_far"].alias("best_value"),
        F.col("_stop")["epoch"].cast("bigint").alias("stop_epoch"),
        chosen["epoch"].cast("bigint").alias("epochs_run"))

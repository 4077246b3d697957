"""A classification head trained by distributed gradient descent (M3 with V7, V12).

Each epoch is one pass: every partition sums its rows' loss and gradient, an aggregate adds
the partitions up, and the driver, which only ever sees as many numbers as the head has
weights, takes the step. The weights of each epoch are written to the shared folder. The
dev rows are measured in the same pass, so an epoch's dev figures come with the pass after
it. Their log has the columns that the checkpoint operators read (``runs``), and these
decide during training when to stop and afterwards which epoch's weights are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import arrays as V
from parallax.operators import runs
from parallax.sources.io import scratch_path, written

LOSS, COUNT, RIGHT = -1, -2, -3  # what a sum that is no gradient is of
LOG = "run string, epoch bigint, train_loss double, dev_loss double, dev_acc double"


def _sums(batches, weights: np.ndarray):
    """(split, x, y) > (split, i, value): the partition's sums, the gradient of train rows by weight number."""
    sums: dict[tuple[str, int], float] = {}
    gradient = np.zeros_like(weights)
    for batch in batches:
        splits = np.array(batch.column(0).to_pylist())
        x = np.array(batch.column(1).to_pylist(), float).reshape(len(splits), -1)
        x = np.hstack((x, np.ones((len(x), 1))))
        y = batch.column(2).to_numpy(zero_copy_only=False)
        z = x @ weights.T
        z -= z.max(axis=1, keepdims=True)
        own = np.arange(len(y))
        losses = np.log(np.exp(z).sum(axis=1)) - z[own, y]
        right = z.argmax(axis=1) == y
        for split in np.unique(splits):
            at = splits == split
            for i, value in ((LOSS, losses[at].sum()), (COUNT, at.sum()), (RIGHT, right[at].sum())):
                sums[split, i] = sums.get((split, i), 0.0) + float(value)
        push = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        push[own, y] -= 1
        gradient += push[splits == "train"].T @ x[splits == "train"]
    keys = list(sums) + [("train", i) for i in range(gradient.size)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.int64()),
         pa.array([*sums.values(), *gradient.ravel().tolist()], pa.float64())], names=["split", "i", "value"])


@dataclass
class TrainedHead:
    """``weights``: the best epoch's, a row per class, the bias last. ``log``: one row an epoch."""

    weights: np.ndarray
    log: DataFrame
    checkpoint: DataFrame
    epochs: DataFrame  # (epoch, class, dimension, weight) of all epochs

    def logits(self, h):
        """V7 over an array column, as a native expression."""
        return V.linear_head(h, self.weights[:, :-1].tolist(), self.weights[:, -1].tolist())


def train(rows: DataFrame, features: str, label: str, classes: int, dimensions: int, epochs: int = 8, rate: float = 0.5,
          patience: int = K.PATIENCE, run: str = "head") -> TrainedHead:
    """Full-batch steps over the train rows of (``split``, features, label).

    Rows with a null label or features of another size are left out. No train row at all:
    the head stays at zero. Without dev rows no epoch counts as an improvement and the
    last weights are kept."""
    spark = rows.sparkSession
    good = (F.size(features) == dimensions) & F.col(label).between(0, classes - 1)
    data = written(rows.where(good & F.col("split").isin("train", "dev")).select(
        "split", F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")), "head-rows")
    shape = (classes, dimensions + 1)
    history, weights, log = scratch_path(spark, "head-weights"), np.zeros(shape), []
    kept: list[np.ndarray] = []
    train_loss = None
    for epoch in range(epochs + 1):
        shared = spark.sparkContext.broadcast(weights)
        sums = data.mapInArrow(lambda b, w=shared: _sums(b, w.value), "split string, i bigint, value double")
        total = {(r["split"], r["i"]): r["v"] for r in
                 sums.groupBy("split", "i").agg(F.sum("value").alias("v")).collect()}
        shared.destroy()
        if epoch:
            n = total.get(("dev", COUNT), 0)
            log.append((run, epoch, train_loss, *((total["dev", LOSS] / n, total["dev", RIGHT] / n) if n else (None, None))))
            stop = epoch > patience and runs.best_checkpoint(_log(spark, log), patience=patience).first()["stop_epoch"]
            if stop or epoch == epochs:
                break
        n = max(total.get(("train", COUNT), 0), 1)
        train_loss = total.get(("train", LOSS), 0.0) / n
        gradient = np.array([total.get(("train", i), 0.0) for i in range(weights.size)]).reshape(shape)
        weights = weights - rate * gradient / n
        kept.append(weights)
        cells = [(epoch + 1, c, d, float(weights[c, d])) for c in range(shape[0]) for d in range(shape[1])]
        spark.createDataFrame(cells, "epoch int, class int, dimension int, weight double").coalesce(1).write.mode(
            "append").parquet(history)
    table = _log(spark, log)
    checkpoint = runs.best_checkpoint(table, patience=patience)
    best = checkpoint.first()["best_epoch"] or len(kept)
    return TrainedHead(kept[best - 1], table, checkpoint, spark.read.parquet(history))


def _log(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), LOG)

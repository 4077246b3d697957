"""Aggregations and evaluation metrics.

All metrics aggregate *counts* in Spark (map-side partial aggregation) and
divide last; only tiny tables (one row per class or per metric) are ever
combined afterwards, and never on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.operators.positional import sorted_positions


def _cnt(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


# A1
def stage_counts(raw: DataFrame, splits: DataFrame, flag: str = "mostly_english") -> DataFrame:
    """(stage, n): raw rows, rows after cleaning, flagged rows, rows per split.

    Cleaned and flagged totals are the rollup total of the split table, so
    the cleaned rows are produced once."""
    r = raw.agg(F.lit("raw").alias("stage"), F.count(F.lit(1)).alias("n"))
    per = splits.rollup("split").agg(F.count(F.lit(1)).alias("n"), _cnt(F.col(flag)).alias("flagged"))
    per = per.select(F.explode(F.array(
        F.struct(F.coalesce("split", F.lit("cleaned")).alias("stage"), F.col("n").alias("n")),
        F.struct(F.when(F.col("split").isNull(), F.lit("flagged")).alias("stage"),
                 F.col("flagged").alias("n")))).alias("s")).select("s.stage", "s.n")
    return r.unionByName(per.filter(F.col("stage").isNotNull()))


# A2
def dataset_statistics(generation: DataFrame, detection: DataFrame) -> DataFrame:
    """Generation and detection rows per split plus a total row (rollup)."""
    rows = (generation.select("split", F.lit("generation").alias("kind"))
            .unionByName(detection.select("split", F.lit("detection").alias("kind"))))
    return (rows.rollup("split")
            .agg(_cnt(F.col("kind") == "generation").alias("generation_rows"),
                 _cnt(F.col("kind") == "detection").alias("detection_rows"))
            .select(F.coalesce("split", F.lit("total")).alias("split"),
                    "generation_rows", "detection_rows"))


# A3
def accuracy(df: DataFrame, columns: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row; ``columns`` names each accuracy and its (gold, pred) columns."""
    columns = columns or {"accuracy": ("gold", "pred")}
    return df.agg(*[F.avg((F.col(pred) == F.col(gold)).cast("double")).alias(name)
                    for name, (gold, pred) in columns.items()])


# A4
def confusion_counts(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))


def binary_error_counts(df: DataFrame, gold: str = "gold", pred: str = "pred",
                        positive: int = 1) -> DataFrame:
    """FP = predicted positive but gold negative; FN the reverse."""
    g, p = F.col(gold), F.col(pred)
    return df.agg(_cnt(g == p).alias("correct"),
                  _cnt((p == positive) & (g != positive)).alias("false_positives"),
                  _cnt((p != positive) & (g == positive)).alias("false_negatives"),
                  F.count(F.lit(1)).alias("total"))


def _row(label: str, p: Column, r: Column, f1: Column, support: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                    r.cast("double").alias("recall"), f1.cast("double").alias("f1"),
                    support.cast("bigint").alias("support"))


# A5
def classification_report(df: DataFrame, gold: str = "gold", pred: str = "pred",
                          class_names: dict | None = None) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted avg.

    One shuffle (the confusion table, at most classes^2 rows); everything
    after works on that tiny table. A zero denominator gives 0.
    Output: (label, precision, recall, f1, support); the accuracy row has
    null precision/recall and f1 = accuracy.
    """
    conf = confusion_counts(df, gold, pred)
    per = (conf.select(F.explode(F.array(
        F.struct(F.col(gold).alias("cls"), F.col("n").alias("gold_n"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("gold_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("r"))
        .groupBy("r.cls").agg(F.sum("r.gold_n").alias("support"), F.sum("r.pred_n").alias("pred_n"),
                              F.sum("r.tp").alias("tp")))
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    if class_names:
        name = F.create_map(*[x for k, v in class_names.items() for x in (F.lit(k), F.lit(v))])[F.col("cls")]
        label = F.coalesce(name, F.col("cls").cast("string"))
    else:
        label = F.col("cls").cast("string")
    classes = per.select(label.alias("label"), "precision", "recall", "f1",
                         F.col("support").cast("bigint").alias("support"))
    total = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                    F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                    F.avg("f1").alias("mf"),
                    F.sum(F.col("precision") * F.col("support")).alias("wp"),
                    F.sum(F.col("recall") * F.col("support")).alias("wr"),
                    F.sum(F.col("f1") * F.col("support")).alias("wf"))
    summary = total.select(F.explode(F.array(
        _row("accuracy", F.lit(None), F.lit(None), F.col("tp") / F.col("n"), F.col("n")),
        _row("macro avg", F.col("mp"), F.col("mr"), F.col("mf"), F.col("n")),
        _row("weighted avg", F.col("wp") / F.col("n"), F.col("wr") / F.col("n"),
             F.col("wf") / F.col("n"), F.col("n")))).alias("s")).select("s.*")
    return classes.unionByName(summary)


# A6
def error_rate(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.agg(_cnt(F.col(gold) != F.col(pred)).alias("errors"),
                  F.count(F.lit(1)).alias("total"),
                  (_cnt(F.col(gold) != F.col(pred)) / F.count(F.lit(1)) * 100).alias("error_pct"))


# A7
def mean_and_median(df: DataFrame, value: str) -> DataFrame:
    """Mean and exact interpolated median without gathering values in one task.

    Distinct values are counted first (map-side combine, so a hot value
    costs nothing), then positioned by a bucketed prefix sum of their
    counts, in at most a fixed number of buckets; only the one or two middle
    values are picked out.
    """
    d = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_w"))
    pos = sorted_positions(d, [value], "_start", size_col="_n", weight_col="_w")
    lo_k = F.floor((F.col("_n") - 1) / 2)
    hi_k = F.ceil((F.col("_n") - 1) / 2)
    covers = lambda k: (F.col("_start") <= k) & (k < F.col("_start") + F.col("_w"))
    v = F.col(value)
    return pos.agg((F.sum(v * F.col("_w")) / F.sum("_w")).alias("mean"),
                   ((F.min(F.when(covers(lo_k), v)) + F.max(F.when(covers(hi_k), v))) / 2)
                   .alias("median"))


# A11
def perplexity(row_losses: DataFrame, loss: str = "row_loss") -> DataFrame:
    """exp(mean of per-row mean loss): rows weigh equally, not tokens."""
    return row_losses.agg(F.exp(F.avg(loss)).alias("perplexity"),
                          F.avg(loss).alias("mean_loss"))


# A12
def mean_of_batch_means(row_losses: DataFrame, position: str, batch_size: int,
                        loss: str = "row_loss") -> DataFrame:
    """Loss as the mean of batch means (a short last batch weighs as much as a full one)."""
    b = (row_losses.groupBy(F.floor(F.col(position) / batch_size).alias("batch_id"))
         .agg(F.avg(loss).alias("batch_loss")))
    return b.agg(F.avg("batch_loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


# J3
def compare_models(metrics: DataFrame, base: str = "zero_shot", tuned: str = "fine_tuned") -> DataFrame:
    """Tidy (task, model, metric, value) rows of two models side by side, and the gain;
    (task, metric) that only one of them has are left out. The metrics are read once."""
    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("value")))

    both = metrics.groupBy("task", "metric").agg(
        of(base).alias(base), of(tuned).alias(tuned),
        F.count_if(F.col("model") == base).alias("_b"), F.count_if(F.col("model") == tuned).alias("_t"))
    return both.filter((F.col("_b") > 0) & (F.col("_t") > 0)).select(
        "task", "metric", base, tuned, (F.col(tuned) - F.col(base)).alias("gain"))


# A13
def comparison_table(metrics: DataFrame, models: Sequence[str] = ("zero_shot", "fine_tuned")) -> DataFrame:
    """metric x model pivot with the gain column (the data behind the bar chart)."""
    p = metrics.groupBy("task", "metric").pivot("model", list(models)).agg(F.first("value"))
    return p.withColumn("gain", F.col(models[1]) - F.col(models[0]))


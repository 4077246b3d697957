"""Sources and sinks.

Files are read with explicit options, columns are bound by *name* (never by
position) and all writes go under a caller-given path - on a cluster a
shared location, never a machine-local folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parallax.functions import text as T
from parallax.session import checkpoint_dir

# FIXED VALUES: cell texts read as missing (the pandas CSV reader's defaults).
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: evaluated once, and kept
    when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# S1
def load_raw(spark: SparkSession, path: str, columns: Sequence[str] = ("egyptian_arabic", "formal_arabic"),
             rename: Sequence[str] = ("src", "tgt"), na_values: Sequence[str] = NA_VALUES,
             multi_line: bool = True) -> DataFrame:
    """CSV with header; quoted cells may hold commas, doubled quotes and
    newlines. Fails if a required column is missing; selects by name;
    ``na_values`` cells become null.

    Cells with newlines can only be told apart from the start of a file, so each
    file is one task; ``multi_line=False``, for files without such cells, lets Spark
    split large files."""
    df = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
          .option("inferSchema", False).csv(path))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"CSV must have columns {list(columns)}; missing {missing}")
    na = list(na_values)
    return df.select(*[F.when(F.col(c).isin(na), F.lit(None).cast("string")).otherwise(F.col(c)).alias(r)
                       for c, r in zip(columns, rename)])


BROKEN = "_corrupt_record"


def csv_with_quarantine(spark: SparkSession, path: str, columns: Sequence[str],
                        na_values: Sequence[str] = NA_VALUES) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken ones) of a CSV file with a header, one record a line.

    A line is broken if it has more or fewer cells than the header, or a quote that is not
    closed on it; it comes back whole as ``record``. Columns are bound by name; a header
    that lacks one is an error. Lines equal to the first file's header are headers; empty
    lines are no records. Both parts are read from one written table."""
    names = spark.read.option("header", True).csv(path).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"CSV must have columns {list(columns)}; missing {missing}")
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"))
    first = lines.first()
    lines = lines.where((F.col("line") != (first["line"] if first else "")) & (F.length("line") > 0))
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("line", f"{cells}, {BROKEN} string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "escape": '"'})
    rows = lines.select("line", parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.when(
        F.col(f"r.{BROKEN}").isNotNull() | (F.length(F.regexp_replace("line", '[^"]', "")) % 2 == 1), F.col("line")).alias(BROKEN))
    return _parted(rows, [F.when(~F.col(c).isin(list(na_values)), F.col(c)).alias(c) for c in columns])


def json_with_quarantine(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken ones) of a file of JSON lines; a line that is no object, or whose
    values don't fit the schema, comes back whole as ``record``."""
    rows = (spark.read.schema(StructType([*schema.fields, StructField(BROKEN, StringType())]))
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path))
    return _parted(rows, [F.col(f"`{f.name}`") for f in schema.fields])


def _parted(rows: DataFrame, columns: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    # written with all its columns: a record counts as broken only where all are parsed
    read = written(rows.withColumnRenamed(BROKEN, "record"), "quarantine")
    return read.where("record is null").select(*columns), read.where("record is not null").select("record")


def with_row_key(df: DataFrame, columns: Sequence[str] = ("src", "tgt"), out: str = "pair_id") -> DataFrame:
    """A key per row that depends on content only: the hash of the columns, and "-ordinal"
    among equal rows.

    Equal rows are counted first, combined before the shuffle, and multiplied
    back from one row per content; no task sorts or numbers the copies of a hot row.
    """
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    counted = df.select(*columns, content.alias("_content")).groupBy("_content").agg(
        *[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    # copies in blocks, so that one content's copies are made by many rows
    block = 1 << 16
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block))))
    spread = blocks.repartition(F.col("_content"), F.col("_b"))
    ordinal = F.explode(F.sequence(F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.col("_n")) - 1))
    return spread.withColumn("_i", ordinal).select(
        F.concat(F.col("_content"), F.lit("-"), F.col("_i").cast("string")).alias(out), *columns)


# S2
def save_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One dataset partitioned by split (readers prune to the split they need).
    CSV output carries a header; Spark writes no byte-order mark."""
    w = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


# S3
def load_processed(spark: SparkSession, path: str, split: str | None = None,
                   cols: Sequence[str] = ("src", "tgt")) -> DataFrame:
    """Read pairs back, cast to string, strip both sides, keep non-empty ones."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    for c in cols:
        df = df.withColumn(c, T.strip_whitespace(F.col(c).cast("string")))
    cond = None
    for c in cols:
        t = F.coalesce(F.length(c) > 0, F.lit(False))
        cond = t if cond is None else cond & t
    return df.filter(cond)


# S4
def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None, exchange: bool = True) -> DataFrame:
    """df as a table bucketed and sorted by ``key``, reread: joins and groupings by the key, with
    tables of as many buckets, need no exchange. The table stays in the session's catalog
    under a name of its own; its files are below ``path``. Without ``exchange`` rows stay with
    their tasks, each of which writes a file per bucket it has: for few large rows."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"parallax_{uuid.uuid4().hex}"
    # one file a bucket: rows come to the writing tasks by bucket
    rows = df.repartition(buckets, key) if exchange else df
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


# S5
def read_export(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                multi_line: bool = True) -> DataFrame:
    """An already-downloaded dataset export (parquet, csv or json); no network.
    ``multi_line=False`` lets Spark split large CSV files without newlines in cells."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return r.format(fmt).load(path)


# S6
def load_feedback(df: DataFrame) -> DataFrame:
    """Select the six feedback columns by name and parse the event time."""
    from parallax.operators.feedback import FEEDBACK_COLUMNS, with_event_time
    extra = [c for c in ("event_id", "pair_key") if c in df.columns]
    return with_event_time(df.select(*extra, *FEEDBACK_COLUMNS))


# S7
def unpack_metrics(df: DataFrame, task_contains: str, names: Sequence[str],
                   task: str = "Task", value: str = "Value", sep: str = " / ") -> DataFrame:
    """Rows whose ``task`` contains the text; a packed 'a / b / c' value
    becomes tidy (task, metric, value DOUBLE) rows (bad numbers -> null)."""
    name_arr = F.array(*[F.lit(n) for n in names])
    picked = df.filter(F.col(task).contains(task_contains))
    parts = picked.select(task, F.posexplode(F.split(F.col(value), sep, -1)).alias("i", "raw"))
    return parts.select(F.col(task).alias("task"), F.element_at(name_arr, F.col("i") + 1).alias("metric"),
                        F.expr("try_cast(raw AS DOUBLE)").alias("value"))

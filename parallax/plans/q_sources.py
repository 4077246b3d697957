"""Registered source/sink round trips: S1-S5, S7 (written under the shared
checkpoint folder, read back, compared with the data they came from)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.operators import curate as C
from parallax.operators import metrics as M
from parallax.operators import positional as G
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.q_curate import RAW_PAIRS
from parallax.plans.q_metrics import report_sql
from parallax.plans.q_sample import SPLIT, split_pairs
from parallax.plans.registry import query
from parallax.sources import io as IO


@query("s01_load_raw_csv",
       S.with_(RAW_PAIRS) + "SELECT pair_id, "
       + ", ".join(f"CASE WHEN {c} IN ({', '.join(S.lit(v) for v in IO.NA_VALUES)}) THEN NULL ELSE {c} END AS {c}"
                   for c in ("src", "tgt")) + " FROM raw_pairs")
def s01(spark, sf):
    back = IO.load_raw(spark, _raw_csv(spark, sf, "pair_id"), ("pair_id", "egyptian_arabic", "formal_arabic"),
                       ("pair_id", "src", "tgt"))
    return back.select("pair_id", "src", "tgt")


def _raw_csv(spark, sf, *columns):
    """The raw pair table as a CSV export in the shared folder."""
    raw = C.pair_turns(I.table(spark, sf, "conversations"), how="left").select(
        *columns, F.col("src").alias("egyptian_arabic"), F.col("tgt").alias("formal_arabic"))
    path = IO.scratch_path(spark, "raw-csv")
    (raw.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _na(c):
    return f"CASE WHEN {c} IN ({', '.join(S.lit(v) for v in IO.NA_VALUES)}) THEN NULL ELSE {c} END"


# The content hash differs between engines' JSON, so the oracle compares what follows
# from the rows alone: exact split sizes, and each curated row as often as it stands there
# in all splits together.
@query("s01_file_to_splits",
       S.with_(RAW_PAIRS) + f""", kept AS (
  SELECT src, tgt, {S.mostly_english('src')} OR {S.mostly_english('tgt')} AS mostly_english
  FROM (SELECT {S.clean('src')} AS src, {S.clean('tgt')} AS tgt
        FROM (SELECT {_na('src')} AS src, {_na('tgt')} AS tgt FROM raw_pairs)
        WHERE src IS NOT NULL AND tgt IS NOT NULL)
  WHERE length(src) > 0 AND length(tgt) > 0),
sizes AS (SELECT count(*) AS n, CAST(ceil((1 - 0.8::DOUBLE) * count(*)) AS BIGINT) AS rest,
                 CAST(ceil(0.5::DOUBLE * ceil((1 - 0.8::DOUBLE) * count(*))) AS BIGINT) AS test FROM kept)
SELECT NULL AS split, src, tgt, mostly_english, count(*) AS n, count(*) AS n_keys FROM kept GROUP BY ALL
UNION ALL SELECT 'train', NULL, NULL, NULL, n - rest, n - rest FROM sizes WHERE n > rest
UNION ALL SELECT 'dev', NULL, NULL, NULL, rest - test, rest - test FROM sizes WHERE rest > test
UNION ALL SELECT 'test', NULL, NULL, NULL, test, test FROM sizes WHERE test > 0""")
def s01_file_to_splits(spark, sf):
    """Raw CSV > row keys > clean > flag > split > save > reread: the size of each split, and
    each distinct row of all splits with its count."""
    raw = IO.written(IO.with_row_key(IO.load_raw(spark, _raw_csv(spark, sf))), "keyed")
    splits = G.split_dataset(C.preprocess_pairs(raw), "pair_id")
    path = IO.scratch_path(spark, "file-to-splits")
    IO.save_splits(splits.select("pair_id", "src", "tgt", "mostly_english", "split"), path)
    back = IO.load_processed(spark, path)
    counts = [F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("n_keys")]
    sizes = back.groupBy("split").agg(*counts)
    rows = back.groupBy("src", "tgt", "mostly_english").agg(*counts)
    null = F.lit(None).cast("string")
    return rows.select(null.alias("split"), "src", "tgt", "mostly_english", "n", "n_keys").unionByName(
        sizes.select("split", null.alias("src"), null.alias("tgt"), F.lit(None).cast("boolean").alias("mostly_english"),
                     "n", "n_keys"))


# Lines of an export, some of them damaged by a rule: which ones, and how, is in both engines the same.


def _plain(c):
    return f"replace(replace(replace(coalesce({c}, ''), chr(10), ' '), chr(13), ' '), '\"', '')"


_LINES = f"""lines AS (
  SELECT conv_id, turn, {_plain('role')} AS role, {_plain('text')} AS text, (conv_id * 31 + turn) % 17 AS fault FROM conversations)"""


@query("s01_s05_quarantine", f"""WITH {_LINES}
SELECT 'csv' AS source, 'good' AS kind, conv_id::VARCHAR AS a, turn::VARCHAR AS b, CASE WHEN text = '' THEN NULL ELSE text END AS c
FROM lines WHERE fault > 2
UNION ALL SELECT 'csv', 'broken', NULL, NULL, CASE fault WHEN 0 THEN conv_id || ',' || turn
    WHEN 1 THEN conv_id || ',' || turn || ',"' || text || '",x' ELSE conv_id || ',' || turn || ',"' || text END FROM lines WHERE fault <= 2
UNION ALL SELECT 'json', 'good', conv_id::VARCHAR, turn::VARCHAR, role FROM lines WHERE fault NOT IN (3, 4)
UNION ALL SELECT 'json', 'broken', NULL, NULL, CASE fault WHEN 3 THEN '{{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role
    ELSE '{{"conv_id":"n' || conv_id || '","turn":' || turn || ',"role":"' || role || '"}}' END FROM lines WHERE fault IN (3, 4)
""")
def s01_s05_quarantine(spark, sf):
    """An export of the conversations as CSV and as JSON lines, read with its broken lines set aside."""
    plain = {c: F.expr(_plain(c)) for c in ("role", "text")}
    rows = I.table(spark, sf, "conversations").select("conv_id", "turn", *[e.alias(c) for c, e in plain.items()],
                                                      ((F.col("conv_id") * 31 + F.col("turn")) % 17).alias("fault"))
    fault = F.col("fault")
    head = F.concat(F.col("conv_id").cast("string"), F.lit(","), F.col("turn").cast("string"))
    csv = (F.when(fault == 0, head).when(fault == 1, F.concat(head, F.lit(',"'), "text", F.lit('",x')))
           .when(fault == 2, F.concat(head, F.lit(',"'), "text")).otherwise(F.concat(head, F.lit(',"'), "text", F.lit('"'))))
    start = F.concat(F.lit(',"turn":'), F.col("turn").cast("string"), F.lit(',"role":"'), F.col("role"))
    json = (F.when(fault == 3, F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"), start))
            .when(fault == 4, F.concat(F.lit('{"conv_id":"n'), F.col("conv_id").cast("string"), F.lit('"'), start, F.lit('"}')))
            .otherwise(F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"), start, F.lit('"}'))))
    at = IO.scratch_path(spark, "broken")
    # each file of the export starts with the header
    lines = rows.select(csv.alias("value")).repartition(3)
    lines.mapInArrow(_headed, "value string").write.text(f"{at}/csv")
    rows.select(json.alias("value")).write.text(f"{at}/json")
    good, broken = IO.csv_with_quarantine(spark, f"{at}/csv", ["conv_id", "turn", "text"])
    fields = T.StructType.fromDDL("conv_id bigint, turn bigint, role string")
    good_json, broken_json = IO.json_with_quarantine(spark, f"{at}/json", fields)
    null = F.lit(None).cast("string")

    def part(source, kind, df, *columns):
        return df.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"),
                         *[c.cast("string").alias(n) for c, n in zip(columns, "abc")])

    return (part("csv", "good", good, F.col("conv_id"), F.col("turn"), F.col("text"))
            .unionByName(part("csv", "broken", broken, null, null, F.col("record")))
            .unionByName(part("json", "good", good_json, F.col("conv_id"), F.col("turn"), F.col("role")))
            .unionByName(part("json", "broken", broken_json, null, null, F.col("record"))))


def _headed(batches):
    yield pa.RecordBatch.from_arrays([pa.array(["conv_id,turn,text"])], names=["value"])
    yield from batches


@query("s02_s03_split_roundtrip",
       S.with_(SPLIT) + "SELECT pair_id, split, src, tgt FROM splits")
def s02(spark, sf):
    path = IO.scratch_path(spark, "splits")
    IO.save_splits(split_pairs(spark, sf).select("pair_id", "src", "tgt", "mostly_english", "split"), path)
    return IO.load_processed(spark, path).select("pair_id", "split", "src", "tgt")


@query("s04_write_result",
       "WITH " + S.emb_pred() + ",\n" + report_sql("emb_pred"))
def s04(spark, sf):
    path = IO.scratch_path(spark, "report")
    IO.write_result(M.classification_report(I.emb_predictions(spark, sf)), path)
    return spark.read.parquet(path)


@query("s05_read_export", "SELECT conv_id, turn, role, text FROM conversations")
def s05(spark, sf):
    conv = I.table(spark, sf, "conversations")
    path = IO.scratch_path(spark, "export-json")
    conv.write.mode("overwrite").json(path)
    return IO.read_export(spark, path, "json", schema=conv.schema).select("conv_id", "turn", "role", "text")


@query("s07_unpack_metrics",
       "WITH " + S.emb_pred() + ",\n" + report_sql("emb_pred").replace("\nSELECT ", ",\nrep AS (SELECT ", 1)
       + ")\n"
       "SELECT label AS task, m.metric, CASE m.metric WHEN 'precision' THEN precision "
       "WHEN 'recall' THEN recall ELSE f1 END AS value "
       "FROM rep CROSS JOIN (VALUES ('precision'), ('recall'), ('f1')) m(metric) WHERE label LIKE '%avg%'")
def s07(spark, sf):
    rep = M.classification_report(I.emb_predictions(spark, sf))
    packed = rep.select(F.col("label").alias("Task"),
                        F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                             for c in ("precision", "recall", "f1")])
                        .alias("Value"))
    return IO.unpack_metrics(packed, "avg", ["precision", "recall", "f1"])

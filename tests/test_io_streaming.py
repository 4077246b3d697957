"""S1-S7 round trips (FIXTURES.md 3.2) and ST1-ST3 streams equal their batch twins."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parallax.operators import feedback as FB
from parallax.plans import inputs as I
from parallax.sources import io as IO
from parallax.streaming import streams as ST
from conftest import SF_SMALL


def test_load_raw_csv_like_pandas(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write('egyptian_arabic,formal_arabic\n"a, ""q""",b\n,c\nNA,d\nnull,e\n"l1\nl2",f\n')
    df = IO.load_raw(spark, path)
    rows = df.collect()
    assert [r.src for r in rows] == ['a, "q"', None, None, None, "l1\nl2"]
    assert df.dropna().count() == 2


def test_load_raw_requires_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError):
        IO.load_raw(spark, path)


def test_load_raw_binds_by_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "swapped.csv")
    with open(path, "w") as f:
        f.write("formal_arabic,egyptian_arabic\nF,E\n")
    r = IO.load_raw(spark, path).first()
    assert (r.src, r.tgt) == ("E", "F")


def test_split_roundtrip_prunes_partitions(spark, tmp_dir):
    df = spark.createDataFrame([(1, " a ", "b", "train"), (2, "c", " ", "dev")],
                               "pair_id long, src string, tgt string, split string")
    IO.save_splits(df, tmp_dir + "/s")
    got = IO.load_processed(spark, tmp_dir + "/s", split="train")
    assert [(r.pair_id, r.src) for r in got.collect()] == [(1, "a")]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()


def _feedback_files(spark, tmp_dir, n_files=4):
    fb = I.evt_feedback(spark, SF_SMALL).drop("pair_key")
    src = os.path.join(tmp_dir, "fb")
    # several files in time order so the watermark advances between micro-batches
    fb = fb.withColumn("_part", (F.col("event_id") * n_files / 1000).cast("int"))
    for p in range(n_files):
        fb.filter(F.col("_part") == p).drop("_part").coalesce(1).write.mode("append").parquet(src)
    return src, fb.drop("_part").schema


def test_routing_stream_matches_batch(spark, tmp_dir):
    src, schema = _feedback_files(spark, tmp_dir)
    out = os.path.join(tmp_dir, "routes")
    q = ST.start_feedback_router(spark, src, schema, out, os.path.join(tmp_dir, "ck1"))
    q.awaitTermination(120)
    streamed = {r.route: r.n for r in spark.read.parquet(out).groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}
    batch = {r.route: r.n for r in FB.route(FB.with_event_time(spark.read.parquet(src)))
             .groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert streamed == batch


def test_daily_stats_stream_drops_late_rows(spark, tmp_dir):
    src, schema = _feedback_files(spark, tmp_dir)
    # a late duplicate-free row from long before the watermark, in a last file
    late = spark.read.parquet(src).limit(1).withColumn("timestamp", F.lit("2023-01-01T00:00:00.000000Z")) \
        .withColumn("egyptian_arabic", F.lit("late"))
    late.write.mode("append").parquet(src + "_late")
    os.rename(next(p for p in [os.path.join(src + "_late", f) for f in os.listdir(src + "_late")] if p.endswith(".parquet")),
              os.path.join(src, "zz-late.parquet"))
    out = os.path.join(tmp_dir, "daily")
    q = ST.start_daily_stats(spark, src, schema, out, os.path.join(tmp_dir, "ck2"))
    q.awaitTermination(180)
    got = spark.read.parquet(out)
    assert got.filter(F.year("day_start") == 2023).count() == 0
    # every emitted day equals the batch computation for that day
    base = FB.with_day(FB.with_event_time(spark.read.parquet(src))).filter(F.year("ts") > 2023)
    batch = {r.day_start: (r.n, round(r.mean_rating, 9))
             for r in FB.daily_feedback_stats(FB.dedup_daily(base)).collect()}
    for r in got.collect():
        assert batch[r.day_start] == (r.n, round(r.mean_rating, 9))
    assert got.count() >= 1


def test_request_stream_matches_batch(spark, tmp_dir):
    docs = I.table(spark, SF_SMALL, "documents").select("doc_id", F.col("text").alias("slang"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "   ")], "doc_id long, slang string"))
    src = os.path.join(tmp_dir, "req")
    docs.write.parquet(src)
    lex = spark.createDataFrame([("the", "ال")], "s string, t string")
    out = os.path.join(tmp_dir, "answers")
    q = ST.start_request_stream(spark, src, docs.schema, "doc_id", lex, out, os.path.join(tmp_dir, "ck3"))
    q.awaitTermination(120)
    streamed = sorted((r.doc_id, r.formal, r.error) for r in spark.read.parquet(out).collect())
    batch = sorted((r.doc_id, r.formal, r.error) for r in ST.answer_requests(ST.prepare_requests(docs), "doc_id", lex).collect())
    assert streamed == batch
    assert [e for d, _, e in streamed if d == -1][0] is not None


def test_request_stream_is_stateless_or_per_batch(spark, tmp_dir):
    """A lexicon that is too large to be broadcast is joined; answers are the same, and a
    restart from the checkpoint adds nothing."""
    docs = I.table(spark, SF_SMALL, "documents").select("doc_id", F.col("text").alias("slang"))
    src = os.path.join(tmp_dir, "req2")
    docs.repartition(3).write.parquet(src)
    lex = spark.createDataFrame([("the", "ال"), ("of", None), (None, "x")], "s string, t string")
    answers = []
    for name, most in (("row", 1 << 20), ("join", 0)):
        out, ck = os.path.join(tmp_dir, name), os.path.join(tmp_dir, "ck-" + name)
        for _ in range(2):
            ST.start_request_stream(spark, src, docs.schema, "doc_id", lex, out, ck, max_files_per_trigger=1,
                                    lexicon_bytes=most).awaitTermination(120)
        rows = spark.read.parquet(out).select("doc_id", "formal", "error").collect()
        answers.append(sorted(rows, key=repr))
        assert len(rows) == docs.count()
    assert answers[0] == answers[1]
    prepared = ST.prepare_requests(docs)
    plan = ST.answer_in_row(prepared, "doc_id", ST.shared_lexicon(lex))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_retraining_table_grows_by_batches(spark, tmp_dir):
    fb = FB.with_event_time(I.evt_feedback(spark, SF_SMALL)).withColumn("batch_id", F.col("event_id") % 5)
    pairs = spark.createDataFrame([("u1", "one"), ("u1", "on"), ("only", "here")], "src string, tgt string")
    table = FB.RetrainingTable(spark, os.path.join(tmp_dir, "retraining"), buckets=8)
    assert table.rows().count() == 0
    assert table.merge_pairs(pairs) >= 1
    assert table.merge_feedback(fb.where("batch_id in (0, 3)"))[0] == 2
    assert table.merge_feedback(fb)[0] == 3
    assert table.merge_feedback(fb) == (0, 0)  # nothing unseen, nothing rewritten
    one = table.merge_feedback(fb.where("event_id = 4").withColumn("batch_id", F.lit(99).cast("long")))
    assert one == (1, 1)  # merging known rows again changes nothing, one bucket is rewritten
    whole = FB.retraining_set(pairs, fb)
    assert sorted(table.rows().collect()) == sorted(whole.collect())


def test_quarantine_keeps_every_line(spark, tmp_dir):
    path = os.path.join(tmp_dir, "broken.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('b,a\n1,x\n2\n3,y,z\n4,"open\n5,"q ""r"""\nNA,\n')
    good, bad = IO.csv_with_quarantine(spark, path, ["a", "b"])
    assert sorted(map(tuple, good.collect()), key=repr) == [('q "r"', "5"), ("x", "1"), (None, None)]
    assert sorted(r.record for r in bad.collect()) == ["2", "3,y,z", '4,"open']
    with pytest.raises(ValueError):
        IO.csv_with_quarantine(spark, path, ["c"])
    path = os.path.join(tmp_dir, "broken.json")
    with open(path, "w") as f:
        f.write('{"a":1,"s":"x"}\n{"a":"no","s":"y"}\n{"a":2\n[1]\n{"s":"only"}\n')
    schema = spark.createDataFrame([], "a long, s string").schema
    good, bad = IO.json_with_quarantine(spark, path, schema)
    assert sorted(map(tuple, good.collect()), key=repr) == [(1, "x"), (None, "only")]
    assert len(bad.collect()) == 3


def test_lists_are_said_by_distinct_words():
    words = {"a": "x", "b": "y y", "": "z"}
    lists = [["a", "q", "a"], None, [], ["b"], ["", "q"], ["a"]]
    tokens = pa.array(lists, pa.list_(pa.string()))
    want = ["x q x", None, "", "y y", "z q", "x"]
    for at in range(len(lists)):
        for n in range(1, len(lists) - at + 1):
            assert ST.said_by(words, tokens.slice(at, n)).to_pylist() == want[at:at + n]


def test_requests_go_to_the_worker_once(spark):
    """One text and its words a request, in slices of bounded rows; answers as row by row."""
    n = 2 * ST.ROWS_AT_ONCE + 3
    req = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 5 = 0 THEN '' ELSE concat('say w', id, ' now\\nlater') END AS slang")
    shared = spark.sparkContext.broadcast({"now": "then", "w1": "one"})
    out = ST.answer_in_row(ST.prepare_requests(req.coalesce(1)), "doc_id", shared)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "said#" in plan and "Exchange" not in plan
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == n and got[5].formal is None and got[5].error
    assert got[1].formal == "say one then later" and got[n - 2].formal.startswith(f"say w{n - 2} then") and got[1].error is None


def test_request_files_grow_with_the_cluster(spark, monkeypatch):
    """As many files as shuffle partitions, in two micro-batches."""
    from parallax.plans import q_streaming as Q
    seen = {}
    start = ST.start_request_stream

    def watched(spark, source, schema, *args, **kw):
        seen.update(files=len(spark.read.parquet(source).inputFiles()), each=kw["max_files_per_trigger"])
        return start(spark, source, schema, *args, **kw)

    monkeypatch.setattr(ST, "start_request_stream", watched)
    got = Q.st1_stream(spark, SF_SMALL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert seen["files"] == parts > 4 and seen["each"] == (parts + 1) // 2
    assert got.count() == I.table(spark, SF_SMALL, "documents").count()

"""Driver contract, oracle agreement at sf0.001 and plan-shape checks."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from parallax.plans import inputs as I
from parallax.plans.registry import ORACLE, QUERIES, load_all
from parallax.operators import overlap as O
from parallax.operators import positional as G

TABLES = ["events", "documents", "embeddings", "labels", "conversations"]
load_all()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = {r.split: r for r in df.collect()}
    assert set(rows) == {"train", "dev", "test", "total"}
    assert rows["total"].detection_rows == 2 * rows["total"].generation_rows
    assert df.columns == ["split", "generation_rows", "detection_rows"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 87


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(rows, cols):
    import math
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v, nested=False):
        if isinstance(v, float):
            return None if math.isnan(v) else v if nested else round(v, 6)
        if isinstance(v, (list, tuple)):  # nested values are compared exactly, as the driver does
            return tuple(n(x, True) for x in v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle_small(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in sdf.collect()], sdf.columns) == _norm(drows, dcols)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_reuse_one_shuffle(spark):
    df = I.table(spark, SF_SMALL, "documents").select("doc_id")
    out = G.random_positions(df, "doc_id")
    out.collect()
    final = _plan(out).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan parquet") == 1


def test_ngram_rows_never_shuffle(spark):
    pairs = I.conv_pairs(spark, SF_SMALL).selectExpr("pair_id", "src AS hyp", "tgt AS ref")
    st = O.chrf_stats(pairs)
    plan = st._jdf.queryExecution().executedPlan().toString()
    # one exchange: the compact rows by pair_id (the J4 join has its own two)
    assert plan.count("Exchange hashpartitioning(pair_id") == 1
    assert "Exchange hashpartitioning(pair_id#" in plan


def test_cleaning_is_evaluated_once(spark):
    def chains(name):  # clean_text strips three times in a row, nothing else does
        return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().count("trim(trim(trim(")
    assert chains("f02_drop_empty") == 1   # one text column
    assert chains("f03_flag_mostly_english") == 2   # two


def test_scan_prunes_columns(spark):
    df = E.queries()["t07_english_ratio"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_jvm_without_cross_joins(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan           # no row-at-a-time Python UDF anywhere
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name != "m01_score_detection_batch_udf":    # the one Arrow-batched model harness
        assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan

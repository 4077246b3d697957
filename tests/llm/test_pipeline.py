"""The pipeline stage by stage against brute force, and on hostile and empty tables."""

import hashlib

import pyarrow.parquet as pq
import pytest

import brute
import corpus_pipeline as pipeline
from parallax.llm import secrets
from parallax.llm.common import written
from test_queries import empty, hostile, small  # noqa: F401


def failed(text):
    """Plain version of the current quality policy."""
    n, chars, symbols, dups, _, base = brute.quality(text)
    lines = len([x for x in (text or "").split("\n") if brute.WORD.search(x)])
    upper = sum(1 for c in text or "" if c.isupper())
    return base or symbols * 10 > n or dups * 10 > lines * 5 or chars < 2 * n or chars > 20 * n or upper * 2 > chars


def holds_secret(text):
    import re
    return any(x > 0 for x in brute.secrets(text)[:3]) or any(re.search(r.pattern, text) for r in secrets.MORE_RULES)


def expected(rows, items):
    """Distinct (key, text) that reach the packing, by brute force."""
    rows = [(k, t) for k, t in rows if not failed(t)]
    near = brute.near(rows)
    groups = {}
    for (k, t), (_, mark, least) in zip(rows, near):
        groups.setdefault((least, mark) if least is None else least, []).append((k is None, k, t))
    firsts = {}
    for name, own in groups.items():
        own.sort(key=lambda x: (x[0], x[1] or 0))
        firsts[name] = {(k, t) for n, k, t in own if (n, k) == own[0][:2]}
    out = []
    for choices in firsts.values():  # repeated keys: any one of them
        kept = [x for x in choices if not brute.leaks(x[1], items)[4] and not holds_secret(x[1])]
        if kept:
            out.append(kept)
    return out


@pytest.mark.parametrize("name", ["small", "hostile"])
def test_pipeline(spark, request, name):
    folder, rows = request.getfixturevalue(name)
    items = [tuple(r.values()) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for stage, run in pipeline.STAGES[:-1]:
        docs = written(run(spark, docs, folder), "stage")
        assert docs.columns == columns, stage
    reached = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected(rows, items)
    assert len(reached) == len(want)
    assert all(any(x in choice for choice in want) for x in reached)
    pieces = pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == {k for k, _ in reached}
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.doc_tokens): p.doc_tokens for p in pieces}.values())


def test_empty(spark, empty):  # noqa: F811
    assert pipeline.run(spark, empty).collect() == []
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import written

ROWS_A_TASK = 500_000  # links that a task takes at least, so that few links aren't spread thin


def _contracted(batches):
    """The links of one partition > each of its nodes with the smallest node it reaches in it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 65_536):
        part = nodes[at:at + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())],
                                         names=["a", "b"])


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; nodes are longs, root is the component's smallest.

    Links are first contracted within their partitions. Each round then hooks all larger
    neighbours of a node to the smallest (large star), and all smaller ones (small star).
    Rounds are written to the shared folder; the rounds needed grow with the logarithm of
    the largest component. Minima are combined before each shuffle; no neighbour list is
    ever gathered.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    links = written(pairs.mapInArrow(_contracted, "a bigint, b bigint"), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(
            max(1, -(-state["n"] // ROWS_A_TASK)))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") > F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

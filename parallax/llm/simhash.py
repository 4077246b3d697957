"""SimHash near-duplicates by pivot distance tables.

A fingerprint has one bit per position where more than half of the text's shingle
hashes have one. For every distinct fingerprint the Hamming distances to many
reference fingerprints (pivots) are computed once. Two fingerprints at distance d
differ by at most d in each of these coordinates, so a pair with a larger
difference anywhere is discarded without a look at its bits; survivors are
verified by their differing bits.

Pairs to be compared are not all pairs: the 64 bits are cut into ``blocks`` runs, and
with at most ``most`` differing bits all but ``most`` runs must agree. A fingerprint is
filed under each choice of the runs that agree; only fingerprints filed together meet,
and no link is lost. Few runs mean few filings and many meetings: with four, half the bits
agree, and it is the pivots that discard nearly all pairs that meet by chance. Fingerprints being distinct, one has no more links than
there are words within ``most`` bits of it, whatever the size of its group of copies.

Null texts count as empty: without words the fingerprint is zero and links like any
other. Repeated rows and null ids get their own result row; a component without any
non-null id has a null component_id; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parallax.llm.common import fresh_name, whole_text, written
from parallax.llm.components import connected_components

SHINGLE = 3
MOST_BITS = 2
BLOCKS = 4
SEED = 42
# Reference fingerprints: the hashes of the first numbers.
PIVOTS = tuple(xxhash.xxh64_intdigest(str(i).encode(), 0) for i in range(16))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed long."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        hashes = np.array([digest(joined[s:e], SEED) for s, e in
                           zip(starts[at:min(n, at + (1 << 16))].tolist(), last[at:at + (1 << 16)].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with a fingerprint column (long)."""
    at = docs.columns.index(text)

    def added(batches):
        for batch in batches:
            raw = [t.as_py() or b"" for t in batch.column(at).cast(pa.string()).cast(pa.binary())]
            yield batch.append_column(out, pa.array([fingerprint(t, shingle) for t in raw], pa.int64()))

    return docs.mapInArrow(added, StructType([*docs.schema.fields, StructField(out, LongType())]))


def distance_table(fp: Column) -> Column:
    """Hamming distances to the pivots."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p))).cast("tinyint")
                     for p in PIVOTS])


def filing_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """The bits kept by each choice of the runs that may differ, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    masks = [(1 << 64) - 1 - sum(free) for free in combinations(runs, most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fingerprints: DataFrame, most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints (``fp``) > pairs (a, b) at ``most`` or fewer differing bits, a < b.

    A pair that agrees in more runs than it must comes once for each choice of them."""
    tabled = fingerprints.select("fp", distance_table(F.col("fp")).alias("pivots"))
    files = F.array(*[F.struct(F.lit(i).alias("file"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept"))
                      for i, m in enumerate(filing_masks(blocks, most))])
    filed = tabled.select("fp", "pivots", F.explode(files).alias("f")).select("fp", "pivots", "f.file", "f.kept")
    one, two = filed.alias("x"), filed.alias("y")
    apart = F.greatest(*[F.abs(F.col("x.pivots")[i].cast("int") - F.col("y.pivots")[i].cast("int"))
                         for i in range(len(PIVOTS))])
    met = one.join(two, (F.col("x.file") == F.col("y.file")) & (F.col("x.kept") == F.col("y.kept"))
                   & (F.col("x.fp") < F.col("y.fp")) & (apart <= most)
                   & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= most))
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def components_of(marked: DataFrame, order: Column, most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(``fp`` and what ``order`` reads) > fp, ``first``: the smallest order in its component."""
    classes = written(marked.groupBy("fp").agg(F.min(order).alias("first")), "fingerprints")
    roots = connected_components(links(classes.select("fp"), most, blocks))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(firsts, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    most: int = MOST_BITS) -> DataFrame:
    """One row per document: key, ``fp`` (long), component_id (smallest key reachable)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    marked = written(with_fingerprint(rows, "text", "fp", shingle).select("key", "fp"), "marked")
    found = components_of(marked, F.col("key"), most)
    return marked.join(found, "fp").select(F.col("key").alias(key), "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             most: int = MOST_BITS) -> DataFrame:
    """One document of each component, the one with the smallest key (null keys last; of
    repeated rows one), with the documents' own columns."""
    fp, row = fresh_name(docs, "fp"), fresh_name(docs, "row")
    marked = with_fingerprint(docs, text, fp, shingle).withColumn(row, F.monotonically_increasing_id())
    marked = written(marked, "marked")
    k = F.col(f"`{key}`")
    order = F.struct(k.isNull().alias("no_key"), k.alias("key"), F.col("row"))
    slim = marked.select(F.col(fp).alias("fp"), k.alias(key), F.col(row).alias("row"))
    first = components_of(slim, order, most).select(F.col("first.row").alias(row)).distinct()
    return marked.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

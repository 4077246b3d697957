"""From raw documents to packed training sequences.

Five stages, each working on all that its predecessor kept and written as Parquet in
the shared folder before the next one reads it:

1. quality rules: documents that the current policy rejects go;
2. SimHash near-dedup: one document of each group of near copies stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. secret scans: documents in whose text a rule finds a secret go;
5. packing: what is left is tokenised and packed into training sequences.

The first four return the columns of their input; the last one row per packed piece.
Nulls, empty texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parallax.llm import packing, quality, secrets, simhash, wumanber
from parallax.llm.common import load, written
from parallax.llm.queries import packed_digest

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wumanber.clean_of(docs, load(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.drop_secret_holders(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack_documents(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scans", scan_secrets),
    ("packing", pack),
]

# SimHash fingerprints and the tokenizer's ids have no SQL form; tests hold the result
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.sources.io import scratch_path as shared_path  # noqa: F401  a new folder below the shared one
from parallax.sources.io import written  # noqa: F401  a table written there and reread

# ASCII white space (space, \t, \n, \x0B, \f, \r): as trim characters and as a Java class.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[ \t\n\x0B\f\r]"
# Word characters of the licence and benchmark operators: digits, letters, all non-ASCII.
TERM_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
TERM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: Column | str = "text") -> Column:
    """The text as a string, null as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def white_words(text: Column) -> Column:
    """Maximal runs without ASCII white space, in order."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_CLASS + "+")) \
        .otherwise(F.array().cast("array<string>"))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of df's (names compare case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name

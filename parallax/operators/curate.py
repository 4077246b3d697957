"""Curation operators: missing-value and empty-text filters, language flag,
request validation (F1-F4, F9) and conversation pairing (J4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import text as T


# F1
def drop_missing(df: DataFrame, cols: Sequence[str] = ("src", "tgt")) -> DataFrame:
    return df.dropna(subset=list(cols))


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with computed columns that later filters and columns read instead of evaluating
    them again: a one-row explode, below which the optimiser pushes no filter."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    kept = [c for c in df.columns if c not in columns]
    out = df.select(*kept, made).select(*kept, *[F.col("_made")[n].alias(n) for n in columns])
    return out.select(*df.columns, *[n for n in columns if n not in df.columns])


# F2
def drop_empty(df: DataFrame, cols: Sequence[str] = ("src", "tgt")) -> DataFrame:
    cond = None
    for c in cols:
        term = F.length(F.col(c)) > 0
        cond = term if cond is None else cond & term
    return df.filter(cond)


# F3
def flag_mostly_english(df: DataFrame, cols: Sequence[str] = ("src", "tgt"),
                        threshold: float = K.MOSTLY_ENGLISH_THRESHOLD,
                        out: str = "mostly_english") -> DataFrame:
    flag = None
    for c in cols:
        term = T.is_mostly_english(c, threshold)
        flag = term if flag is None else flag | term
    return df.withColumn(out, flag)


# F4 (off by default in the curation flow)
def drop_flagged(df: DataFrame, flag: str = "mostly_english") -> DataFrame:
    return df.filter(~F.col(flag))


def preprocess_pairs(df: DataFrame, normalize: bool = False, hard_drop_english: bool = False,
                     cols: Sequence[str] = ("src", "tgt")) -> DataFrame:
    """F1 > T6 on both sides > F2 > F3 (> F4): one narrow stage, no shuffle."""
    out = drop_missing(df, cols)
    out = evaluated_once(out, {c: T.clean_text(c, normalize) for c in cols})
    out = flag_mostly_english(drop_empty(out, cols), cols)
    return drop_flagged(out) if hard_drop_english else out


# F9
def validate_request(df: DataFrame, text_col: str = "slang", out_text: str = "slang_clean",
                     out_error: str = "error") -> DataFrame:
    """Strip the request; an empty one gets the error message instead of text."""
    stripped = T.strip_whitespace(F.coalesce(F.col(text_col), F.lit("")))
    return (df.withColumn(out_text, F.when(F.length(stripped) > 0, stripped))
              .withColumn(out_error, F.when(F.length(stripped) == 0, F.lit(K.EMPTY_INPUT_ERROR))))


# J4
def pair_turns(conversations: DataFrame, src_role: str = "user",
               tgt_role: str = "assistant", how: str = "inner") -> DataFrame:
    """Parallel rows from adjacent turns: a ``src_role`` turn and the
    ``tgt_role`` turn right after it in the same conversation.

    An equi-join on the composite key (conv_id, turn) rather than a window
    over conv_id: a single huge conversation is then spread over many
    partitions instead of landing in one task. ``how="left"`` keeps
    source turns with no answer (target null), i.e. the raw pair table.
    ``pair_id`` is "conversation:turn" of the source turn, so no two pairs
    share one however long a conversation is.
    """
    u = (conversations.filter(F.col("role") == src_role)
         .select("conv_id", F.col("turn"), F.col("text").alias("src"),
                 (F.col("turn") + 1).alias("_next")))
    a = (conversations.filter(F.col("role") == tgt_role)
         .select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"),
                 F.col("text").alias("tgt")))
    return (u.join(a, (u.conv_id == a._c) & (u._next == a._t), how)
            .select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("pair_id"),
                    "conv_id", "turn", "src", "tgt"))


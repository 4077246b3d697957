"""Vocabulary, encoding and batching of model inputs (V1, V2, V4).

Tokens are whitespace tokens. Ids: 0 pad, 1 end-of-sequence, 2 unknown,
then 3.. by descending corpus count (ties by token).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import arrays as V
from parallax.functions import text as T
from parallax.operators.curate import evaluated_once
from parallax.sources.io import written
from parallax.operators.positional import sorted_positions

# FIXED VALUES: special token ids.
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
FIRST_TOKEN_ID = 3


# V1
def build_vocabulary(texts: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """(token, count, id). Counting is a partial aggregation (hot tokens are
    combined map-side); the global rank by (count desc, token) takes one range
    exchange of the distinct tokens."""
    toks = texts.select(F.explode(T.whitespace_tokens(text_col)).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    if min_count > 1:
        counts = counts.filter(F.col("count") >= min_count)
    counts = counts.withColumn("_less", -F.col("count"))
    ranked = sorted_positions(counts, ["_less", "token"], "_rank")
    return ranked.select("token", "count", (F.col("_rank") + FIRST_TOKEN_ID).alias("id"))


# V2
def encode(df: DataFrame, key: str, text_cols: Sequence[str], vocab: DataFrame,
           suffix: str = "_ids", constants: Sequence[str] = ()) -> DataFrame:
    """Token ids for each text column, in order; unknown tokens -> UNK_ID, a null text -> no ids.

    All columns are exploded as one tagged array, joined to the vocabulary once (AQE
    broadcasts a small vocabulary and splits hot tokens of a big one) and regrouped by
    the row key into ordered arrays. Each group is a single row's tokens.

    ``constants`` are words that (nearly) every row holds, such as a prompt template's:
    their ids are looked up once, at most one per constant, and they ride with the row
    instead of being joined and shuffled token by token.
    """
    def side(i: int, c: str) -> Column:
        toks = F.coalesce(T.whitespace_tokens(c), F.array().cast("array<string>"))
        return F.arrays_zip(F.array_repeat(F.lit(i), F.size(toks)).alias("side"), toks.alias("token"))

    names = sorted(set(constants))
    known = {r["token"]: r["id"] for r in vocab.filter(F.col("token").isin(names)).collect()} if names else {}
    tagged = F.concat(*[side(i, c) for i, c in enumerate(text_cols)])
    rows = evaluated_once(df.select(key, *text_cols), {"_all": F.transform(tagged, lambda t, i: F.struct(
        i.alias("pos"), t["side"].alias("side"), t["token"].alias("token")))})
    if names:
        ids = F.create_map(*[F.lit(x) for w in names for x in (w, int(known.get(w, UNK_ID)))])
        fixed = F.transform(F.filter("_all", lambda t: t["token"].isin(names)), lambda t: F.struct(
            t["pos"].alias("pos"), t["side"].alias("side"), F.element_at(ids, t["token"]).alias("id")))
        rest = F.filter("_all", lambda t: ~t["token"].isin(names))
    else:
        fixed, rest = F.array(), F.col("_all")
    kind = "array<struct<pos:int,side:int,id:int>>"
    ex = rows.select(key, fixed.cast(kind).alias("_fixed"), F.posexplode_outer(rest).alias("_n", "_t"))
    ex = ex.select(key, F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_fixed")).alias("_fixed"), "_t.*")
    v = vocab.select(F.col("token").alias("_tok"), F.col("id").cast("int").alias("_id"))
    j = ex.join(v, ex.token == v._tok, "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "side", F.coalesce("_id", F.lit(UNK_ID)).alias("id")))
    g = j.groupBy(key).agg(F.collect_list(item).cast(kind).alias("_own"), F.first("_fixed", ignorenulls=True).alias("_fixed"))
    g = g.select(key, F.array_sort(F.concat("_own", "_fixed")).alias("_a"))

    def ids_of(i: int) -> Column:
        return F.filter("_a", lambda t: t["side"] == i)["id"]

    return g.select(key, *[ids_of(i).alias(c + suffix) for i, c in enumerate(text_cols)])


# V4
def pad_batches(df: DataFrame, position: str, ids: str = "input_ids", labels: str = "labels",
                batch_size: int = K.GEN_BATCH_SIZE, pad_id: int = PAD_ID) -> DataFrame:
    """batch_id = floor(position / size); left-pad ids (pad_id), labels (-100)
    and mask (0) to the longest row of the batch. A batch is ``batch_size``
    rows, so the per-batch window is bounded."""
    b = df.withColumn("batch_id", F.floor(F.col(position) / batch_size))
    b = b.withColumn("_len", F.max(F.size(ids)).over(Window.partitionBy("batch_id")))
    return (b.withColumn("attention_mask", V.left_pad_mask(ids, "_len"))
             .withColumn(labels, V.left_pad(labels, "_len", K.IGNORE_INDEX))
             .withColumn(ids, V.left_pad(ids, "_len", pad_id))
             .drop("_len"))

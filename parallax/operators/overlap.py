"""N-gram overlap metrics: corpus BLEU (A8), corpus chrF (A9), sentence chrF (A10).

Plan shape: the compact (id, hyp, ref) rows are hash-partitioned by id once.
chrF sorts them by key there and counts the n-grams of one key after the other in
Arrow batches: no n-gram is a row, and a task holds one key's counts. BLEU explodes
the word n-grams of both sides *inside* that partition as one
tagged array (no union), so the (id, n, gram) and (id, n) aggregations are
satisfied by the existing partitioning and never shuffle the n-gram rows.
The corpus total is a global aggregate of a few numbers per partition.
Counts are summed first; precision/recall/F are computed last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from parallax import constants as K

CHRF_ORDER = 6
CHRF_BETA = 2
BLEU_ORDER = 4
_STATS = ArrayType(StructType([StructField("n", IntegerType()), *(StructField(c, LongType()) for c in ("hyp", "ref", "match"))]))

# FIXED VALUES: 13a tokenizer rules (regex, replacement), applied in order
# after '<skipped>' removal, '-\n' removal, '\n' -> ' ', entity unescaping
# and padding with one space on each side.
TOKENIZE_13A_RULES = [
    (r"([\{-~\[-` -&\(-\+:-@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ENTITIES_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def tokenize_13a(c) -> Column:
    s = F.replace(_col(c), F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for ent, ch in ENTITIES_13A:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in TOKENIZE_13A_RULES:
        s = F.regexp_replace(s, pat, rep)
    return F.array_remove(F.split(s, f"{K.JWS_CLASS}+"), "")


def strip_all_whitespace(c) -> Column:
    return F.regexp_replace(_col(c), f"{K.JWS_CLASS}+", "")


def char_ngram_strings(c, max_n: int = CHRF_ORDER) -> Column:
    """array<string> of all overlapping character n-grams, n = 1..max_n.

    One regex scan per order: ``(?=(.{n})).`` consumes one code point at a
    time (also outside the BMP) and captures the n from there, so extraction
    runs in the (codegen'd) regex engine instead of one lambda call per gram.
    The gram's length is its order, so no tag is needed."""
    s = _col(c)
    return F.flatten(F.array(*[F.regexp_extract_all(s, F.lit("(?s)(?=(.{%d}))." % n), 1)
                              for n in range(1, max_n + 1)]))


# chrF ------------------------------------------------------------------------

def _gram_counts(text: str) -> list[Counter]:
    """The character n-grams of a text, counted per order 1..CHRF_ORDER."""
    return [Counter([text[i:i + n] for i in range(len(text) - n + 1)]) for n in range(1, CHRF_ORDER + 1)]


def _order_stats(hyp: list[Counter], ref: list[Counter]) -> list[dict]:
    """(n, hyp, ref, match) of each order with n-grams; order 0 stands for the row itself."""
    out = [{"n": 0, "hyp": 0, "ref": 0, "match": 0}]
    for n, (h, r) in enumerate(zip(hyp, ref), 1):
        n_ref = r.total()
        if h or n_ref:
            match = sum([min(h[g], r[g]) for g in h.keys() & r.keys()])
            out.append({"n": n, "hyp": h.total() if n_ref else 0, "ref": n_ref, "match": match})
    return out


def _same_key(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _stats_of_sorted(batches, n_keys: int, schema: pa.Schema):
    """One row per key of rows sorted by it; of the rows only the present key's counts are held."""
    key, counts = None, None
    for batch in batches:
        keys, stats = [], []
        for *own, h, r in zip(*(c.to_pylist() for c in batch.columns)):
            grams = _gram_counts(h), _gram_counts(r)
            if key is not None and _same_key(key, own):
                for mine, more in zip(counts, grams):
                    for c, m in zip(mine, more):
                        c.update(m)
                continue
            if key is not None:
                keys.append(key)
                stats.append(_order_stats(*counts))
            key, counts = own, grams
        if keys:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*keys), schema.types)),
                                              pa.array(stats, schema.types[n_keys])], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([c], t) for c, t in zip(key, schema.types)),
                                          pa.array([_order_stats(*counts)], schema.types[n_keys])], schema=schema)


def _key_stats(df: DataFrame, keys: Sequence[str], id_col: str, hyp: str, ref: str) -> DataFrame:
    """(keys, stats): an array of (n, hyp, ref, match) per key, whose rows are counted as one.

    Rows are hash-partitioned by id and sorted by key, so a task counts the n-grams of one key
    after the other; no n-gram becomes a row. Rows with a null side are left out."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pre = df.select(*keys, strip_all_whitespace(hyp).alias("_h"), strip_all_whitespace(ref).alias("_r"))
    parted = pre.where("_h is not null and _r is not null").repartition(n_parts, id_col).sortWithinPartitions(*keys)
    out = StructType([*(parted.schema[k] for k in keys), StructField("stats", _STATS)])
    arrow = to_arrow_schema(out)
    return parted.mapInArrow(lambda b: _stats_of_sorted(b, len(keys), arrow), out)


def chrf_stats(df: DataFrame, id_col: str = "pair_id", hyp: str = "hyp", ref: str = "ref",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (id, n) chrF statistics; hyp counts are 0 where the reference has
    no n-gram of that order."""
    keys = [id_col, *group_cols]
    st = _key_stats(df, keys, id_col, hyp, ref).select(*keys, F.explode("stats").alias("_s"))
    return st.select(*keys, *[F.col("_s")[c].alias(c) for c in ("n", "hyp", "ref", "match")])


def _chrf_from_sums(hyp: Column, ref: Column, match: Column, beta: int = CHRF_BETA) -> dict:
    """Aggregate expressions over per-n rows that yield the chrF score."""
    eff = (hyp > 0) & (ref > 0)
    prec = F.sum(F.when(eff, match / hyp).otherwise(0.0))
    rec = F.sum(F.when(eff, match / ref).otherwise(0.0))
    k = F.sum(F.when(eff, 1).otherwise(0))
    return {"prec": prec, "rec": rec, "k": k}


def _f_beta(prec_sum: Column, rec_sum: Column, k: Column, beta: int = CHRF_BETA) -> Column:
    p = F.when(k > 0, prec_sum / k).otherwise(0.0)
    r = F.when(k > 0, rec_sum / k).otherwise(0.0)
    f2 = beta * beta
    return F.when(p + r > 0, 100.0 * (1 + f2) * p * r / (f2 * p + r)).otherwise(0.0)


def sentence_chrf(df: DataFrame, id_col: str = "pair_id", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(id, chrf) for every row, unrounded; rows with no n-grams score 0."""
    eff = F.filter("stats", lambda s: (s["hyp"] > 0) & (s["ref"] > 0))

    def share_sum(of):  # of at most CHRF_ORDER shares
        return F.aggregate(F.transform("_e", lambda s: s["match"] / s[of]), F.lit(0.0), lambda a, x: a + x)

    per = _key_stats(df, [id_col], id_col, hyp, ref).select(id_col, eff.alias("_e")).select(
        id_col, share_sum("hyp").alias("_p"), share_sum("ref").alias("_r"), F.size("_e").alias("_k"))
    return per.select(id_col, _f_beta(F.col("_p"), F.col("_r"), F.col("_k")).alias("chrf"))


def corpus_chrf(df: DataFrame, id_col: str = "pair_id", hyp: str = "hyp", ref: str = "ref",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Corpus chrF (one row, or one per ``group_cols`` value in one pass)."""
    st = chrf_stats(df, id_col, hyp, ref, group_cols)
    per_n = st.groupBy(*group_cols, "n").agg(F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"),
                                             F.sum("match").alias("match"))
    e = _chrf_from_sums(F.col("hyp"), F.col("ref"), F.col("match"))
    return per_n.groupBy(*group_cols).agg(_f_beta(e["prec"], e["rec"], e["k"]).alias("chrf"))


# BLEU ------------------------------------------------------------------------

def _tagged_strings(hyp_grams: Column, ref_grams: Column) -> Column:
    """One array of (gram, side) structs built natively (arrays_zip, no
    lambda): side 1 = hypothesis, 2 = reference, 0 = sentinel."""
    def zipped(arr: Column, side: int) -> Column:
        return F.arrays_zip(arr.alias("g"), F.array_repeat(F.lit(side), F.size(arr)).alias("t"))
    sentinel = F.array(F.struct(F.lit("").alias("g"), F.lit(0).alias("t")))
    return F.concat(zipped(hyp_grams, 1), zipped(ref_grams, 2), sentinel)


def word_ngram_strings(joined, max_n: int = BLEU_ORDER) -> Column:
    """array<string> of all word n-grams (n = 1..max_n) of a text whose
    tokens are joined by single spaces: a lookahead anchored at each token
    start captures the next n tokens (one regex scan per order)."""
    s = _col(joined)
    return F.flatten(F.array(*[
        F.regexp_extract_all(s, F.lit("(?<![^ ])(?=([^ ]+" + "(?: [^ ]+)" * (n - 1) + "))"), 1)
        for n in range(1, max_n + 1)]))


def bleu_stats(df: DataFrame, id_col: str = "pair_id", hyp: str = "hyp", ref: str = "ref",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Corpus sums (per group): correct_n, total_n (n = 1..4), sys_len, ref_len.

    13a tokens (which never contain whitespace) are joined by single spaces
    before the exchange; word n-grams are then extracted by regex inside
    the id's partition, and a gram's order is its number of spaces + 1."""
    keys = [id_col, *group_cols]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tok = df.select(*keys, F.array_join(tokenize_13a(hyp), " ").alias("_h"),
                    F.array_join(tokenize_13a(ref), " ").alias("_r"))
    parted = tok.repartition(n_parts, id_col)
    g = parted.select(*keys, F.explode(_tagged_strings(word_ngram_strings("_h"),
                                                       word_ngram_strings("_r"))).alias("t"))
    per_gram = (g.groupBy(*keys, F.col("t.g").alias("g"))
                .agg(F.sum((F.col("t.t") == 1).cast("int")).alias("hc"),
                     F.sum((F.col("t.t") == 2).cast("int")).alias("rc")))
    order = F.when(F.col("g") == "", 0).otherwise(F.size(F.split(F.col("g"), " ")))
    st = (per_gram.groupBy(*keys, order.alias("n"))
          .agg(F.sum("hc").alias("hyp"), F.sum("rc").alias("ref"),
               F.sum(F.least("hc", "rc")).alias("match")))

    def total(c, n):
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).cast("bigint")
    # Unigram totals are the token counts, so lengths need no second pass.
    return st.groupBy(*group_cols).agg(
        *[total("match", n).alias(f"correct_{n}") for n in range(1, BLEU_ORDER + 1)],
        *[total("hyp", n).alias(f"total_{n}") for n in range(1, BLEU_ORDER + 1)],
        total("hyp", 1).alias("sys_len"), total("ref", 1).alias("ref_len"))


def bleu_from_stats(stats: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU with exponential smoothing of zero-match orders and brevity penalty."""
    logs = []
    zeros = F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        c, t = F.col(f"correct_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when(c == 0, 1).otherwise(0)
        p = F.when(c == 0, 100.0 / (F.pow(F.lit(2.0), zeros) * t)).otherwise(100.0 * c / t)
        logs.append(F.log(p))
    no_total = F.col(f"total_{BLEU_ORDER}") == 0
    no_match = sum((F.col(f"correct_{n}") for n in range(1, BLEU_ORDER + 1)), F.lit(0)) == 0
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = F.when(sys_len < ref_len,
                F.when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(0.0)).otherwise(1.0)
    geo = F.exp(sum(logs[1:], logs[0]) / BLEU_ORDER)
    score = F.when(no_total | no_match, 0.0).otherwise(bp * geo)
    return stats.select(*group_cols, score.alias("bleu"), "sys_len", "ref_len",
                        *[f"correct_{n}" for n in range(1, BLEU_ORDER + 1)],
                        *[f"total_{n}" for n in range(1, BLEU_ORDER + 1)])


def corpus_bleu(df: DataFrame, id_col: str = "pair_id", hyp: str = "hyp", ref: str = "ref",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU (one row, or one per ``group_cols`` value in one pass)."""
    return bleu_from_stats(bleu_stats(df, id_col, hyp, ref, group_cols), group_cols)

"""Candidate re-ranking over (group_id, candidate_id, logit) tables.

A group is one decision step (its candidates are bounded by the vocabulary
size), so per-group windows are bounded; Spark plans ``row_number() <= k``
as a WindowGroupLimit that keeps only k rows per group before the sort.
Order of application: repetition penalty > temperature > top-k > nucleus >
deterministic sampled pick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax import constants as K

G = "group_id"
C = "candidate_id"


def _by_group() -> Window:
    return Window.partitionBy(G)


def _desc(col: str) -> Window:
    return Window.partitionBy(G).orderBy(F.col(col).desc(), F.col(C))


# W6
def repetition_penalty(cands: DataFrame, seen: DataFrame, penalty: float = K.REPETITION_PENALTY,
                       logit: str = "logit") -> DataFrame:
    """Already-seen candidates: negative logit x penalty, otherwise / penalty."""
    s = seen.select(F.col(G).alias("_g"), F.col(C).alias("_c")).distinct() \
        .withColumn("_seen", F.lit(True))
    j = cands.join(s, (cands[G] == s._g) & (cands[C] == s._c), "left")
    pen = F.when(F.col(logit) < 0, F.col(logit) * penalty).otherwise(F.col(logit) / penalty)
    return j.withColumn(logit, F.when(F.col("_seen"), pen).otherwise(F.col(logit))) \
        .drop("_g", "_c", "_seen")


def _softmax_over_group(x: Column) -> Column:
    m = F.max(x).over(_by_group())
    return F.exp(x - m) / F.sum(F.exp(x - m)).over(_by_group())


# W3
def temperature(cands: DataFrame, t: float = K.TEMPERATURE, logit: str = "logit",
                out: str = "prob") -> DataFrame:
    """prob = softmax(logit / t) within the group (max-shifted)."""
    return cands.withColumn(out, _softmax_over_group(F.col(logit) / t))


# W4
def top_k(cands: DataFrame, k: int = K.TOP_K, score: str = "logit") -> DataFrame:
    """The k best candidates per group (ties broken by candidate id)."""
    return (cands.withColumn("rank", F.row_number().over(_desc(score)))
            .filter(F.col("rank") <= k))


def renormalize(cands: DataFrame, prob: str = "prob") -> DataFrame:
    return cands.withColumn(prob, F.col(prob) / F.sum(prob).over(_by_group()))


# W5
def nucleus(cands: DataFrame, p: float = K.TOP_P, prob: str = "prob") -> DataFrame:
    """Smallest prefix (by prob desc) whose mass reaches p; at least one row."""
    before = _desc(prob).rowsBetween(Window.unboundedPreceding, -1)
    return (cands.withColumn("_cum_before", F.coalesce(F.sum(prob).over(before), F.lit(0.0)))
            .filter(F.col("_cum_before") < p).drop("_cum_before"))


def uniform(key: Column, seed: int = K.SEED) -> Column:
    """Deterministic uniform [0, 1) from md5('<seed>:<key>') (13 hex digits)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def sample_pick(cands: DataFrame, prob: str = "prob", seed: int = K.SEED) -> DataFrame:
    """One candidate per group: the first (by prob desc) whose cumulative
    probability exceeds the group's deterministic uniform draw."""
    upto = _desc(prob).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = (cands.withColumn("_cum", F.sum(prob).over(upto))
         .withColumn("_u", uniform(F.col(G), seed)))
    hit = c.filter(F.col("_cum") > F.col("_u"))
    first = hit.groupBy(G).agg(F.min(F.struct(F.col("_cum"), F.col(C))).alias("_m"))
    return first.select(G, F.col("_m")[C].alias(C))


def rerank(cands: DataFrame, seen: DataFrame, penalty: float = K.REPETITION_PENALTY,
           t: float = K.TEMPERATURE, k: int = K.TOP_K, p: float = K.TOP_P,
           seed: int = K.SEED) -> DataFrame:
    """W6 > W3 > W4 > W5 > pick: one chosen candidate per group."""
    x = repetition_penalty(cands, seen, penalty)
    x = x.withColumn("scaled", F.col("logit") / t)
    x = top_k(x, k, "scaled")
    x = x.withColumn("prob", _softmax_over_group(F.col("scaled")))
    x = renormalize(nucleus(x, p))
    return sample_pick(x, seed=seed)


def previous_top(cands: DataFrame, k: int = 3, logit: str = "logit") -> DataFrame:
    """'Seen' ids for a step: the top-k candidates of the previous group."""
    return top_k(cands, k, logit).select((F.col(G) + 1).alias(G), C)

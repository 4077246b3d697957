"""Beam search over lexicon candidates and a bigram model (M2).

Each source word has a few candidate targets with log probabilities; what an output word
scores further depends on the word before it (bigram model) and on all words that its own
beam has already said (W6). Spark's joins bring a sentence's candidates and the scores of
all their neighbouring pairs into one row; the fold over the sentence then keeps ``width``
beams, so it needs time in proportion to the sentence times the width.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.operators.models import BigramLM

WIDTH = 3
CANDIDATES = 3
DIGITS = 9  # scores that agree to so many decimals are ties: the smaller words win


def best_beam(candidates: Sequence[Sequence[tuple[str, float]]], pair_score: dict[tuple[int, int, int], float],
              width: int = WIDTH, penalty: float = K.REPETITION_PENALTY) -> tuple[list[str], float]:
    """The best beam's words and score. ``candidates``: per position (word, log probability);
    ``pair_score``: (i, a, b) > log probability of candidate b of position i + 1 after a of i.

    A beam is (score, number of its candidate, words said, its path as a chain); beams stand
    in the order of their words, so that ties need no comparison of whole outputs."""
    beams: list[tuple[float, int, set[str], tuple | None]] = [(0.0, -1, set(), None)]
    for i, here in enumerate(candidates):
        made = []
        for rank, (score, last, said, _) in enumerate(beams):
            for b, (word, logit) in enumerate(here):
                logit += pair_score[i - 1, last, b] if i else 0.0
                if word in said:
                    logit = logit * penalty if logit < 0 else logit / penalty
                made.append((-round(score + logit, DIGITS), rank, word, b, score + logit))
        kept = sorted(sorted(made)[:width], key=lambda m: (m[1], m[2]))
        heirs = [m[1] for m in kept]
        after = []
        for at, (_, rank, word, b, score) in enumerate(kept):
            said = beams[rank][2]
            if rank in heirs[at + 1:]:  # the last heir takes the set over
                said = set(said)
            said.add(word)
            after.append((score, b, said, (beams[rank][3], word)))
        beams = after
    best = min(range(len(beams)), key=lambda r: (-round(beams[r][0], DIGITS), r))
    words, chain = [], beams[best][3]
    while chain is not None:
        chain, word = chain
        words.append(word)
    return words[::-1], beams[best][0]


def _decoded(batches, width, penalty):
    for batch in batches:
        texts, scores = [], []
        for cells, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words, score = best_beam([[(c["t"], c["lp"]) for c in cell] for cell in cells or []],
                                     {(p["i"], p["a"], p["b"]): p["lp"] for p in pairs or []}, width, penalty)
            texts.append(" ".join(words))
            scores.append(score)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(scores, pa.float64())],
                                         names=["key", "text", "score"])


def beam_search(df: DataFrame, key: str, tokens: str, lexicon: DataFrame, lm: BigramLM, width: int = WIDTH,
                most: int = CANDIDATES, penalty: float = K.REPETITION_PENALTY) -> DataFrame:
    """(key, text, score) of each row's token array.

    ``lexicon``: (s, t, p, rank), the candidates of a source word in order of rank; words it
    lacks are copied at no cost. ``key`` tells rows apart. Null and empty rows give an empty text."""
    own = lexicon.where(F.col("rank") <= most).groupBy("s").agg(
        F.array_sort(F.collect_list(F.struct("rank", "t", F.log("p").alias("lp")))).alias("c"))
    words = df.select(F.col(key).alias("key"), F.posexplode_outer(tokens).alias("i", "tok"))
    met = words.join(own.withColumnRenamed("s", "tok"), "tok", "left")
    cell = F.coalesce(F.transform("c", lambda c: F.struct(c["t"].alias("t"), c["lp"].alias("lp"))),
                      F.array(F.struct(F.col("tok").alias("t"), F.lit(0.0).alias("lp"))))
    cells = met.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct(
        "i", cell.alias("cell"))))).alias("a")).select("key", F.col("a.cell").alias("cells"))
    # every pair of neighbouring candidates once, with its place
    steps = cells.select("key", F.posexplode(F.arrays_zip(
        F.slice("cells", F.lit(1), F.greatest(F.size("cells") - 1, F.lit(0))).alias("l"),
        F.slice("cells", 2, F.size("cells")).alias("r"))).alias("i", "s")).where(F.col("s.r").isNotNull())
    left = steps.select("key", "i", "s.r", F.posexplode("s.l").alias("a", "l"))
    pairs = left.select("key", "i", "a", F.col("l.t").alias("v"), F.posexplode("r").alias("b", "r")).select(
        "key", "i", "a", "b", "v", F.col("r.t").alias("w"))
    scored = lm.log_probability(pairs, "lp").groupBy("key").agg(
        F.collect_list(F.struct("i", "a", "b", "lp")).alias("pairs"))
    whole = cells.join(scored, "key", "left").select("key", "cells", "pairs")
    kind = whole.schema["key"].dataType.simpleString()
    out = whole.mapInArrow(lambda b: _decoded(b, width, penalty), f"key {kind}, text string, score double")
    return out.withColumnRenamed("key", key)

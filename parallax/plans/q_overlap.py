"""Registered n-gram metric queries: A7-A10, G6, G7, J2 over CONV pairs.

The scored system is the echo baseline (hypothesis = source turn) against
the following turn as reference, over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.operators import metrics as M
from parallax.operators import overlap as O
from parallax.operators.pairing import align
from parallax.operators.positional import sorted_positions
from parallax.functions import text as T
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.registry import query
from parallax.sources.io import scratch_path, write_bucketed, written


def scored_pairs(spark, sf):
    return I.conv_pairs(spark, sf).select("pair_id", F.col("src").alias("hyp"),
                                          F.col("tgt").alias("ref"))


def sentence_scores(spark, sf):
    """(pair_id, chrf) with chrF rounded to 2 decimals, as reported per sentence."""
    s = O.sentence_chrf(scored_pairs(spark, sf))
    return s.select("pair_id", F.round("chrf", 2).alias("chrf"))


# -- oracle SQL -------------------------------------------------------------

PAIRS_SQL = S.CONV_PAIRS + """,
p AS (SELECT pair_id, src AS hyp, tgt AS ref FROM conv_pairs)"""

WS = S.lit(K.WS_CLASS)


def _ngram_union(src: str, pre: str, max_n: int, gram_fn) -> str:
    return f"""{pre}g AS (
  SELECT pair_id, n, unnest({gram_fn('h')}) AS gram, 1 AS hc, 0 AS rc
  FROM {src} CROSS JOIN range(1, {max_n + 1}) t(n)
  UNION ALL
  SELECT pair_id, n, unnest({gram_fn('r')}) AS gram, 0 AS hc, 1 AS rc
  FROM {src} CROSS JOIN range(1, {max_n + 1}) t(n)),
{pre}pg AS (SELECT pair_id, n, gram, sum(hc) AS hc, sum(rc) AS rc FROM {pre}g GROUP BY pair_id, n, gram),
{pre}pn AS (SELECT pair_id, n, sum(hc) AS hyp, sum(rc) AS ref, sum(least(hc, rc)) AS match
       FROM {pre}pg GROUP BY pair_id, n)"""


def _char_grams(s: str) -> str:
    return f"list_transform(range(1, length({s}) - n + 2), lambda i: substring({s}, i, n))"


def _word_grams(t: str) -> str:
    return f"list_transform(range(1, len({t}) - n + 2), lambda i: array_to_string({t}[i : i + n - 1], ' '))"


def _fbeta_sql(ps: str, rs: str, k: str) -> str:
    p = f"(CASE WHEN {k} > 0 THEN {ps} / {k} ELSE 0.0 END)"
    r = f"(CASE WHEN {k} > 0 THEN {rs} / {k} ELSE 0.0 END)"
    return f"(CASE WHEN {p} + {r} > 0 THEN 100.0 * 5 * {p} * {r} / (4 * {p} + {r}) ELSE 0.0 END)"


EFF = "hyp > 0 AND ref > 0"


def chrf_ctes(src: str, pre: str) -> str:
    """CTEs over view ``src`` (pair_id, hyp, ref): {pre}st per (pair_id, n) and
    {pre}chrf with the corpus chrF."""
    return f"""{pre}x AS (SELECT pair_id, regexp_replace(hyp, {WS}, '', 'g') AS h,
             regexp_replace(ref, {WS}, '', 'g') AS r FROM {src}),
{_ngram_union(pre + 'x', pre, O.CHRF_ORDER, _char_grams)},
{pre}st AS (SELECT pair_id, n, CASE WHEN ref > 0 THEN hyp ELSE 0 END AS hyp, ref, match FROM {pre}pn),
{pre}chrf AS (SELECT {_fbeta_sql(f'sum(CASE WHEN {EFF} THEN match / hyp ELSE 0 END)',
                                 f'sum(CASE WHEN {EFF} THEN match / ref ELSE 0 END)',
                                 f'sum(CASE WHEN {EFF} THEN 1 ELSE 0 END)')} AS chrf
  FROM (SELECT n, sum(hyp) AS hyp, sum(ref) AS ref, sum(match) AS match FROM {pre}st GROUP BY n))"""


def _tok13a_sql(e: str) -> str:
    s = f"replace(replace(replace({e}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for ent, ch in O.ENTITIES_13A:
        s = f"replace({s}, {S.lit(ent)}, {S.lit(ch)})"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in O.TOKENIZE_13A_RULES:
        s = f"regexp_replace({s}, {S.lit(pat)}, {S.lit(rep.replace('$', chr(92)))}, 'g')"
    return f"list_filter(string_split_regex({s}, {S.lit(K.WS_CLASS + '+')}), lambda t: t <> '')"


def _bleu_score_sql() -> str:
    logs, zeros = [], []
    for n in range(1, 5):
        zeros.append(f"(CASE WHEN correct_{n} = 0 THEN 1 ELSE 0 END)")
        z = " + ".join(zeros)
        logs.append(f"ln(CASE WHEN correct_{n} = 0 THEN 100.0 / (pow(2.0, {z}) * total_{n}) "
                    f"ELSE 100.0 * correct_{n} / total_{n} END)")
    bp = ("(CASE WHEN sys_len < ref_len THEN (CASE WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) "
          "ELSE 0.0 END) ELSE 1.0 END)")
    return (f"CASE WHEN total_4 = 0 OR correct_1 + correct_2 + correct_3 + correct_4 = 0 THEN 0.0 "
            f"ELSE {bp} * exp(({' + '.join(logs)}) / 4) END")


def bleu_ctes(src: str, pre: str) -> str:
    """CTEs over view ``src`` (pair_id, hyp, ref): {pre}sums (corpus counts)
    and {pre}bleu (score + counts)."""
    sums = ", ".join(
        [f"CAST(coalesce(sum(match) FILTER (WHERE n = {n}), 0) AS BIGINT) AS correct_{n}" for n in range(1, 5)]
        + [f"CAST(coalesce(sum(hyp) FILTER (WHERE n = {n}), 0) AS BIGINT) AS total_{n}" for n in range(1, 5)])
    return f"""{pre}x AS (SELECT pair_id, {_tok13a_sql('hyp')} AS h, {_tok13a_sql('ref')} AS r FROM {src}),
{_ngram_union(pre + 'x', pre, O.BLEU_ORDER, _word_grams)},
{pre}sums AS (SELECT {sums},
                CAST(coalesce(sum(hyp) FILTER (WHERE n = 1), 0) AS BIGINT) AS sys_len,
                CAST(coalesce(sum(ref) FILTER (WHERE n = 1), 0) AS BIGINT) AS ref_len FROM {pre}pn),
{pre}bleu AS (SELECT {_bleu_score_sql()} AS bleu, * FROM {pre}sums)"""


CHRF_STATS_SQL = PAIRS_SQL + ",\n" + chrf_ctes("p", "c_")
SENT_SQL = CHRF_STATS_SQL + f""",
agg AS (SELECT pair_id, sum(CASE WHEN {EFF} THEN match / hyp ELSE 0 END) AS ps,
               sum(CASE WHEN {EFF} THEN match / ref ELSE 0 END) AS rs,
               sum(CASE WHEN {EFF} THEN 1 ELSE 0 END) AS k FROM c_st GROUP BY pair_id),
sent AS (SELECT p.pair_id, round(coalesce({_fbeta_sql('ps', 'rs', 'k')}, 0.0), 2) AS chrf
         FROM p LEFT JOIN agg ON p.pair_id = agg.pair_id)"""


# -- queries ----------------------------------------------------------------

@query("a08_corpus_bleu",
       S.with_(PAIRS_SQL + ",\n" + bleu_ctes("p", "b_")) + "SELECT bleu, sys_len, ref_len, "
       + ", ".join(f"correct_{n}" for n in range(1, 5)) + ", "
       + ", ".join(f"total_{n}" for n in range(1, 5)) + " FROM b_bleu")
def a08(spark, sf):
    return O.corpus_bleu(scored_pairs(spark, sf))


@query("a09_corpus_chrf", S.with_(CHRF_STATS_SQL) + "SELECT chrf FROM c_chrf")
def a09(spark, sf):
    return O.corpus_chrf(scored_pairs(spark, sf))


@query("a10_sentence_chrf", S.with_(SENT_SQL) + "SELECT pair_id, chrf FROM sent")
def a10(spark, sf):
    return sentence_scores(spark, sf)


@query("a07_mean_median_chrf",
       S.with_(SENT_SQL) + "SELECT avg(chrf) AS mean, median(chrf) AS median FROM sent")
def a07(spark, sf):
    return M.mean_and_median(written(sentence_scores(spark, sf), "scores"), "chrf")


def sorted_by_score(scores, id_col="pair_id", score="chrf"):
    """Rank rows by (score asc, id asc). The scores are written once, as the
    bucket bounds and the ranks both read them; a hot score is split by id."""
    return sorted_positions(written(scores.select(id_col, score), "scores"), [score, id_col], "rank")


@query("g06_sort_by_chrf",
       S.with_(SENT_SQL) + "SELECT pair_id, chrf, row_number() OVER (ORDER BY chrf, pair_id) - 1 AS rank "
       "FROM sent")
def g06(spark, sf):
    return sorted_by_score(sentence_scores(spark, sf))


@query("g07_worst_best",
       S.with_(SENT_SQL) + """SELECT * FROM (SELECT 'worst' AS kind, pair_id, chrf FROM sent
                             ORDER BY chrf, pair_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'best' AS kind, pair_id, chrf FROM sent
                         ORDER BY chrf DESC, pair_id DESC LIMIT 5)""")
def g07(spark, sf):
    return worst_and_best(sentence_scores(spark, sf), 5)


def worst_and_best(scores, k: int, id_col: str = "pair_id", score: str = "chrf"):
    """The k lowest (score, id) and the k highest (score desc, id desc)
    rows in one pass: each row is offered to both lists with mirrored sort
    keys and ``row_number() <= k`` per list runs as a WindowGroupLimit that
    keeps k rows per task before the (two-key) shuffle."""
    both = scores.select(id_col, score, F.explode(F.array(F.lit("worst"), F.lit("best"))).alias("kind"))
    worst = F.col("kind") == "worst"
    w = Window.partitionBy("kind").orderBy(F.when(worst, F.col(score)).otherwise(-F.col(score)),
                                           F.when(worst, F.col(id_col)), F.when(~worst, F.col(id_col)).desc())
    return (both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            .select("kind", id_col, score))


def _j02_sql():
    prompt = S.template(K.GEN_PROMPT_QUOTED, slang="src")
    out = f"({prompt} || tgt)"
    first = f"split_part(substring({out}, length({prompt}) + 1), chr(10), 1)"
    return S.with_(S.CONV_PAIRS) + f"""SELECT h.pair_id, h.hyp, r.ref FROM
  (SELECT pair_id, {S.strip(first)} AS hyp FROM conv_pairs) h
  JOIN (SELECT pair_id, {S.clean('tgt')} AS ref FROM conv_pairs) r ON h.pair_id = r.pair_id"""


@query("j02_align_hypotheses", _j02_sql())
def j02(spark, sf):
    pairs = I.conv_pairs(spark, sf).withColumn("prompt", T.generation_prompt("src", quoted=True))
    hyp = pairs.select("pair_id", T.postprocess_completion(F.concat("prompt", "tgt"), F.col("prompt"))
                       .alias("hyp"))
    ref = I.conv_pairs(spark, sf).select("pair_id", T.clean_text("tgt").alias("ref"))
    return align(hyp, ref)


@query("j02_align_bucketed", _j02_sql())
def j02_bucketed(spark, sf):
    """The same over two stored tables bucketed by pair: neither side moves for the join."""
    pairs = I.conv_pairs(spark, sf).withColumn("prompt", T.generation_prompt("src", quoted=True))
    at = scratch_path(spark, "bucketed")
    hyp = write_bucketed(pairs.select("pair_id", T.postprocess_completion(
        F.concat("prompt", "tgt"), F.col("prompt")).alias("hyp")), f"{at}/hyp", "pair_id")
    ref = write_bucketed(I.conv_pairs(spark, sf).select("pair_id", T.clean_text("tgt").alias("ref")), f"{at}/ref", "pair_id")
    return align(hyp, ref)

"""Registered model-job queries: M1-M6, A11, A12, J3, A13 on the CONV split."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import text as T
from parallax.operators import metrics as M
from parallax.operators import models as MD
from parallax.operators import overlap as O
from parallax.operators.pairing import build_detection_examples
from parallax.plans import sqlfrag as S
from parallax.plans.q_metrics import report_sql
from parallax.plans.q_overlap import _fbeta_sql, bleu_ctes, chrf_ctes
from parallax.plans.q_sample import EXAMPLES, SPLIT, split_pairs
from parallax.plans.q_runs import rerank_ctes
from parallax.plans.jobs import evaluate_detection
from parallax.plans.registry import ORACLE, query
from parallax.sources.io import scratch_path, written


def _sequences(pairs):
    """Split pairs with full-sequence tokens (quoted prompt + target) and the prompt length."""
    prompt = T.generation_prompt("src", quoted=True)
    return pairs.select("pair_id", "split", "split_pos",
                        T.whitespace_tokens(F.concat(prompt, F.col("tgt"))).alias("tokens"),
                        F.size(T.whitespace_tokens(prompt)).alias("n_prompt"))


def _row_losses(seqs, target_only: bool = False):
    lm = MD.BigramLM.fit(seqs.filter(F.col("split") == "train"), "tokens")
    return lm.row_loss(seqs.filter(F.col("split") == "test"), ["pair_id", "split_pos"], "tokens",
                       F.col("n_prompt") if target_only else None)


def row_losses(spark, sf, target_only: bool = False):
    return _row_losses(_sequences(_split_stage(spark, sf)), target_only)


# -- oracle views -----------------------------------------------------------

def _lm_sql(target_only: bool) -> str:
    prompt = S.template(K.GEN_PROMPT_QUOTED, slang="src")
    cond = "AND b.i >= b.np" if target_only else ""
    return SPLIT + f""",
seqs AS (SELECT pair_id, split, split_pos, {S.tokens(f'({prompt} || tgt)')} AS t,
                len({S.tokens(prompt)}) AS np FROM splits),
bg AS (SELECT pair_id, split, split_pos, np, i, t[i] AS v, t[i + 1] AS w
       FROM (SELECT *, unnest(range(1, len(t))) AS i FROM seqs)),
cvw AS (SELECT v, w, count(*) AS c_vw FROM bg WHERE split = 'train' GROUP BY v, w),
cv AS (SELECT v, count(*) AS c_v FROM bg WHERE split = 'train' GROUP BY v),
vs AS (SELECT count(DISTINCT tok) + 1 AS n FROM (SELECT unnest(t) AS tok FROM seqs WHERE split = 'train')),
scored AS (
  SELECT b.pair_id, b.split_pos,
         -ln((coalesce(cvw.c_vw, 0) + {MD.ADD_K!r}) / (coalesce(cv.c_v, 0) + {MD.ADD_K!r} * vs.n)) AS nll
  FROM bg b LEFT JOIN cvw ON b.v = cvw.v AND b.w = cvw.w LEFT JOIN cv ON b.v = cv.v CROSS JOIN vs
  WHERE b.split = 'test' {cond}),
losses AS (SELECT pair_id, split_pos, avg(nll) AS row_loss, count(*) AS n_scored FROM scored
           GROUP BY pair_id, split_pos)"""


LEXICON_SQL = SPLIT + f""",
tt AS (SELECT {S.tokens('src')} AS s, {S.tokens('tgt')} AS t FROM splits WHERE split = 'train'),
al AS (SELECT s[i] AS s, t[CAST(ceil(i * len(t) / len(s)) AS BIGINT)] AS t
       FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM tt WHERE len(s) > 0 AND len(t) > 0)),
cnt AS (SELECT s, t, count(*) AS count FROM al GROUP BY s, t),
lexicon AS (SELECT s, t, count FROM (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY count DESC, t) AS r FROM cnt) WHERE r = 1)"""


def _translate_sql(src_view: str, key: str, text: str, name: str) -> str:
    return f"""{name}_ex AS (SELECT {key}, unnest(tk) AS tok, generate_subscripts(tk, 1) AS pos
       FROM (SELECT {key}, {S.tokens(text)} AS tk FROM {src_view})),
{name}_tr AS (SELECT e.{key}, array_to_string(list(coalesce(l.t, e.tok) ORDER BY e.pos), ' ') AS tr
       FROM {name}_ex e LEFT JOIN lexicon l ON e.tok = l.s GROUP BY e.{key}),
{name} AS (SELECT v.*, coalesce(x.tr, '') AS tr FROM {src_view} v LEFT JOIN {name}_tr x ON v.{key} = x.{key})"""


def _generated_sql() -> str:
    prompt = S.template(K.GEN_PROMPT_QUOTED, slang="src")
    out = f"({prompt} || tr)"
    first = f"split_part(substring({out}, length({prompt}) + 1), chr(10), 1)"
    return LEXICON_SQL + ",\n" + _translate_sql(
        "(SELECT * FROM splits WHERE split = 'test')", "pair_id", "src", "gen") + f""",
generated AS (SELECT pair_id, src, tgt, {S.strip(first)} AS generated FROM gen)"""


def _overlap_sql(a: str, b: str) -> str:
    da = f"list_distinct({S.tokens(a)})"
    return (f"(CASE WHEN len({da}) > 0 THEN len(list_intersect({da}, {S.tokens(b)})) / len({da}) "
            "ELSE 0.0 END)")


FEATURES_SQL = f"""
feats AS (
  SELECT split, example_id, src, tgt, label, unnest(list_concat(list_concat(
           list_transform(s, lambda x: 's:' || x), list_transform(t, lambda x: 't:' || x)), list_concat(
           list_transform(list_distinct(list_intersect(s, t)), lambda x: 'x:' || x),
           ['n:' || len(list_distinct(list_intersect(s, t)))]))) AS feature
  FROM (SELECT *, {S.tokens('src')} AS s, {S.tokens('tgt')} AS t FROM examples)),
fc AS (SELECT feature, count(*) FILTER (WHERE label = 1) AS c1, count(*) FILTER (WHERE label = 0) AS c0
       FROM feats WHERE split = 'train' GROUP BY feature),
ft AS (SELECT sum(c1)::DOUBLE + {MD.SMOOTHING!r} * count(*) AS m1, sum(c0)::DOUBLE + {MD.SMOOTHING!r} * count(*) AS m0 FROM fc),
nb AS (
  SELECT example_id, src, tgt, label, sum(ln((coalesce(c1, 0) + {MD.SMOOTHING!r}) / m1)
                              - ln((coalesce(c0, 0) + {MD.SMOOTHING!r}) / m0)) AS log_odds
  FROM feats LEFT JOIN fc USING (feature) CROSS JOIN ft WHERE split = 'test' GROUP BY ALL),
nbj AS (
  SELECT *, CAST(log_odds > 0 AS INTEGER) AS pred,
         CASE WHEN log_odds > 0 THEN 'correct' ELSE 'incorrect' END AS label_pred,
         round(1 / (1 + exp(-abs(log_odds))), 4) AS confidence FROM nb)"""

ZERO_SQL = f"""
zd AS (SELECT label, CAST({_overlap_sql('src', 'tgt')} >= {MD.OVERLAP_THRESHOLD!r} AS INTEGER) AS zs
       FROM examples WHERE split = 'test'),
zs_p AS (SELECT pair_id, src AS hyp, tgt AS ref FROM splits WHERE split = 'test'),
{chrf_ctes('zs_p', 'zc_')},
{bleu_ctes('zs_p', 'zb_')},
zero AS (
  SELECT 'detection' AS task, 'zero_shot' AS model, 'accuracy' AS metric,
         avg(CAST(zs = label AS DOUBLE)) AS value FROM zd
  UNION ALL SELECT 'generation', 'zero_shot', 'chrf', chrf FROM zc_chrf
  UNION ALL SELECT 'generation', 'zero_shot', 'bleu', bleu FROM zb_bleu
  UNION ALL SELECT 'generation', 'zero_shot', 'perplexity', n::DOUBLE FROM vs)"""

LM_PARTS = _lm_sql(False).split(SPLIT + ",\n", 1)[1]
M6_SQL = EXAMPLES + ",\n" + LM_PARTS + "," + ZERO_SQL

METRICS_SQL = M6_SQL + ",\n" + LEXICON_SQL.split(SPLIT + ",\n", 1)[1] + "," + FEATURES_SQL + ",\n" + \
    _translate_sql("(SELECT * FROM splits WHERE split = 'test')", "pair_id", "src", "gen") + f""",
ft_p AS (SELECT pair_id, tr AS hyp, tgt AS ref FROM gen),
{chrf_ctes('ft_p', 'fc_')},
{bleu_ctes('ft_p', 'fb_')},
metrics AS (
  SELECT * FROM zero
  UNION ALL SELECT 'detection', 'fine_tuned', 'accuracy', avg(CAST(pred = label AS DOUBLE)) FROM nbj
  UNION ALL SELECT 'generation', 'fine_tuned', 'chrf', chrf FROM fc_chrf
  UNION ALL SELECT 'generation', 'fine_tuned', 'bleu', bleu FROM fb_bleu
  UNION ALL SELECT 'generation', 'fine_tuned', 'perplexity', exp(avg(row_loss)) FROM losses)"""


# -- Spark side of the comparison ---------------------------------------------

def lexicon(spark, sf):
    return _lexicon(split_pairs(spark, sf))


def _lexicon(pairs):
    p = pairs.filter(F.col("split") == "train")
    toks = p.select(T.whitespace_tokens("src").alias("s"), T.whitespace_tokens("tgt").alias("t"))
    return MD.train_lexicon(toks, "s", "t")


def _tidy(df, task: str, metric: str, value: str, model: str):
    return df.select(F.lit(task).alias("task"), F.lit(model).alias("model"), F.lit(metric).alias("metric"),
                     F.col(value).cast("double").alias("value"))


def _generation_metrics(scored):
    """chrF and BLEU rows of (model, pair_id, hyp, ref): all models in one pass over their n-grams."""
    def tidy(df, metric):
        return df.select(F.lit("generation").alias("task"), "model", F.lit(metric).alias("metric"),
                         F.col(metric).cast("double").alias("value"))

    return tidy(O.corpus_chrf(scored, group_cols=["model"]), "chrf").unionByName(
        tidy(O.corpus_bleu(scored, group_cols=["model"]), "bleu"))


def _hypotheses(df, model: str, hyp: str):
    return df.select(F.lit(model).alias("model"), "pair_id", F.col(hyp).alias("hyp"), F.col("tgt").alias("ref"))


def _split_stage(spark, sf):
    """The split pairs, written once: every part of the comparison reads them."""
    return written(split_pairs(spark, sf), "splits")


def zero_shot_metrics(pairs):
    """M6: token overlap for detection, and the perplexity of an untrained (uniform) language
    model over the training vocabulary."""
    test = pairs.filter(F.col("split") == "test")
    det = MD.overlap_detector(build_detection_examples(test)).select("pred", F.col("label").alias("gold"))
    seqs = _sequences(pairs)
    vocab = seqs.filter(F.col("split") == "train").select(F.explode("tokens").alias("t")).groupBy("t").count().agg(
        (F.count(F.lit(1)) + 1).alias("perplexity"))
    return (_tidy(M.accuracy(det), "detection", "accuracy", "accuracy", "zero_shot")
            .unionByName(_tidy(vocab, "generation", "perplexity", "perplexity", "zero_shot")))


def echoed(pairs):
    """M6: the source of each test pair as its generation."""
    return _hypotheses(MD.echo_generator(pairs.filter(F.col("split") == "test")), "zero_shot", "generated")


def trained_metrics(pairs):
    """The trained pair classifier (M3) and language model (M5) on the test split."""
    ex = build_detection_examples(pairs)
    scored = MD.judged(detector(ex).score(ex.filter(F.col("split") == "test"), "example_id", ["label"]))
    return (_tidy(M.accuracy(scored.select("pred", F.col("label").alias("gold"))),
                  "detection", "accuracy", "accuracy", "fine_tuned")
            .unionByName(_tidy(M.perplexity(_row_losses(_sequences(pairs))), "generation", "perplexity",
                               "perplexity", "fine_tuned")))


def translated(pairs):
    """The trained lexicon's (M4) generation of each test pair."""
    test = pairs.filter(F.col("split") == "test")
    tr = MD.translate(test.select("pair_id", "tgt", T.whitespace_tokens("src").alias("_t")), "pair_id", "_t",
                      _lexicon(pairs), "hyp", ["tgt"])
    return _hypotheses(tr, "fine_tuned", "hyp")


def detector(examples):
    return MD.TokenLogOdds.fit(examples.filter(F.col("split") == "train"))


def metrics_table(spark, sf):
    """Tidy (task, model, metric, value) of both systems on the test split."""
    pairs = _split_stage(spark, sf)
    said = written(echoed(pairs).unionByName(translated(pairs)), "hypotheses")
    return zero_shot_metrics(pairs).unionByName(trained_metrics(pairs)).unionByName(_generation_metrics(said))


# -- queries ----------------------------------------------------------------

@query("m05_row_loss", S.with_(_lm_sql(False)) + "SELECT pair_id, row_loss, n_scored FROM losses")
def m05(spark, sf):
    return row_losses(spark, sf).select("pair_id", "row_loss", "n_scored")


@query("m05_row_loss_target_only",
       S.with_(_lm_sql(True)) + "SELECT pair_id, row_loss, n_scored FROM losses")
def m05t(spark, sf):
    return row_losses(spark, sf, target_only=True).select("pair_id", "row_loss", "n_scored")


@query("a11_perplexity",
       S.with_(_lm_sql(False)) + "SELECT exp(avg(row_loss)) AS perplexity, avg(row_loss) AS mean_loss FROM losses")
def a11(spark, sf):
    return M.perplexity(row_losses(spark, sf))


@query("a12_mean_of_batch_means",
       S.with_(_lm_sql(True)) + f"""SELECT avg(bl) AS loss, count(*) AS batches FROM (
  SELECT floor(split_pos / {K.GEN_BATCH_SIZE}) AS b, avg(row_loss) AS bl FROM losses GROUP BY b)""")
def a12(spark, sf):
    return M.mean_of_batch_means(row_losses(spark, sf, target_only=True), "split_pos", K.GEN_BATCH_SIZE)


@query("m04_lexicon", S.with_(LEXICON_SQL) + "SELECT s, t, count FROM lexicon")
def m04(spark, sf):
    return lexicon(spark, sf)


@query("m02_generate", S.with_(_generated_sql()) + "SELECT pair_id, generated FROM generated")
def m02(spark, sf):
    pairs = _split_stage(spark, sf)
    test = pairs.filter(F.col("split") == "test").select("pair_id", "src", "tgt")
    return MD.generate(test, "pair_id", _lexicon(pairs)).select("pair_id", "generated")


def _reranked_sql() -> str:
    """The generated texts with the re-ranked lexicon in place of the most frequent targets."""
    head, tail = _generated_sql().split("lexicon AS (", 1)
    _, rest = tail.split("WHERE r = 1)", 1)
    return head + f"""pen AS (SELECT s AS group_id, t AS candidate_id,
               CASE WHEN s = t THEN ln(count) / {K.REPETITION_PENALTY!r} ELSE ln(count) END AS logit FROM cnt),
{rerank_ctes().replace("t AS (SELECT", "tmp AS (SELECT", 1).replace("FROM t)", "FROM tmp)")},
lexicon AS (SELECT group_id AS s, candidate_id AS t FROM picked)""" + rest


@query("m02_generate_reranked", S.with_(_reranked_sql()) + "SELECT pair_id, generated FROM generated")
def m02_reranked(spark, sf):
    """M2 with each word's target drawn from all its candidates."""
    pairs = _split_stage(spark, sf)
    toks = pairs.filter(F.col("split") == "train").select(T.whitespace_tokens("src").alias("s"),
                                                          T.whitespace_tokens("tgt").alias("t"))
    lex = MD.reranked_lexicon(written(MD.aligned_counts(toks, "s", "t"), "aligned"))
    test = pairs.filter(F.col("split") == "test").select("pair_id", "src")
    return MD.generate(test, "pair_id", lex).select("pair_id", "generated")


@query("m06_zero_shot_baseline",
       "WITH " + M6_SQL + "\nSELECT task, model, metric, value FROM zero")
def m06(spark, sf):
    pairs = _split_stage(spark, sf)
    return zero_shot_metrics(pairs).unionByName(_generation_metrics(echoed(pairs)))


@query("j03_compare_models",
       "WITH " + METRICS_SQL + """
SELECT a.task, a.metric, a.value AS zero_shot, b.value AS fine_tuned, b.value - a.value AS gain
FROM metrics a JOIN metrics b ON a.task = b.task AND a.metric = b.metric
WHERE a.model = 'zero_shot' AND b.model = 'fine_tuned'""")
def j03(spark, sf):
    return M.compare_models(metrics_table(spark, sf))


@query("a13_comparison_table",
       "WITH " + METRICS_SQL + """
SELECT task, metric, max(value) FILTER (WHERE model = 'zero_shot') AS zero_shot,
       max(value) FILTER (WHERE model = 'fine_tuned') AS fine_tuned,
       max(value) FILTER (WHERE model = 'fine_tuned') - max(value) FILTER (WHERE model = 'zero_shot') AS gain
FROM metrics GROUP BY task, metric""")
def a13(spark, sf):
    return M.comparison_table(metrics_table(spark, sf))


# M3 / M1

def detection_examples(spark, sf):
    return written(build_detection_examples(_split_stage(spark, sf)).select(
        "split", "example_id", "src", "tgt", "label"), "examples")


def judged_test_examples(spark, sf, keep=("label",)):
    """The trained classifier's verdicts on the test examples."""
    ex = detection_examples(spark, sf)
    return MD.judged(detector(ex).score(ex.filter(F.col("split") == "test"), "example_id", list(keep)))


@query("m03_pair_classifier_report",
       "WITH " + EXAMPLES + "," + FEATURES_SQL + ",\nnbp AS (SELECT label AS gold, pred FROM nbj),\n"
       + report_sql("nbp", {0: "incorrect", 1: "correct"}))
def m03(spark, sf):
    scored = judged_test_examples(spark, sf)
    return M.classification_report(scored.select(F.col("label").alias("gold"), "pred"),
                                   class_names={0: "incorrect", 1: "correct"})


@query("m03_pair_classifier_scores",
       "WITH " + EXAMPLES + "," + FEATURES_SQL + "\nSELECT example_id, CAST(label AS INTEGER) AS label, pred, label_pred, confidence FROM nbj")
def m03_scores(spark, sf):
    return judged_test_examples(spark, sf).select(
        "example_id", "label", "pred", "label_pred", "confidence")


_OVERLAP = _overlap_sql("src", "tgt")


@query("m01_score_detection",
       S.with_(EXAMPLES) + f"""SELECT example_id, CAST(label AS INTEGER) AS label,
       CASE WHEN o > 1 - o THEN 'correct' ELSE 'incorrect' END AS label_pred,
       round(1 / (exp(least(o, 1 - o) - greatest(o, 1 - o)) + 1), 4) AS confidence
FROM (SELECT *, {_OVERLAP} AS o FROM examples WHERE split = 'test')""")
def m01(spark, sf):
    """M1 by the native overlap scorer, over the test examples."""
    ex = build_detection_examples(split_pairs(spark, sf).filter(F.col("split") == "test"))
    return MD.score_detection(ex.select("example_id", "src", "tgt", "label")).select(
        "example_id", "label", "label_pred", "confidence")


@query("m01_score_detection_batch_udf",
       S.with_(EXAMPLES) + """SELECT example_id, CAST(label AS INTEGER) AS label,
       CASE WHEN o > 1 - o THEN 'correct' ELSE 'incorrect' END AS label_pred,
       round(1 / (exp(least(o, 1 - o) - greatest(o, 1 - o)) + 1), 4) AS confidence
FROM (SELECT *, least(length(src), length(tgt)) / greatest(length(src), length(tgt), 1) AS o
      FROM examples WHERE split = 'test')""")
def m01_udf(spark, sf):
    """M1 through the pluggable vectorised harness (predict_batch_udf, Arrow
    batches) with the length loader, over the test examples."""
    ex = build_detection_examples(split_pairs(spark, sf).filter(F.col("split") == "test"))
    return MD.score_detection(ex.select("example_id", "src", "tgt", "label"),
                              loader=MD.length_logits_loader).select(
        "example_id", "label", "label_pred", "confidence")


# F5 / G7 over texts: what the trained classifier gets wrong, and the score table of generation.

_ERRORS = "WITH " + EXAMPLES + "," + FEATURES_SQL + """,
errors AS (
  SELECT example_id, src, tgt, CASE WHEN label = 1 THEN 'correct' ELSE 'incorrect' END AS gold,
         label_pred AS predicted, confidence FROM nbj WHERE pred <> label)
"""


def detection_errors(spark, sf):
    judged = judged_test_examples(spark, sf, ("label", "src", "tgt"))
    return judged.filter(F.col("pred") != F.col("label")).select(
        "example_id", "src", "tgt", T.label_name(F.col("label")).alias("gold"),
        F.col("label_pred").alias("predicted"), "confidence")


@query("f05_detection_errors", _ERRORS + "SELECT * FROM errors")
def f05_errors(spark, sf):
    return detection_errors(spark, sf)


@query("g07_first_errors", _ERRORS + "SELECT * FROM errors ORDER BY example_id LIMIT 5")
def g07_first(spark, sf):
    """The first five errors, by example id."""
    return detection_errors(spark, sf).orderBy("example_id").limit(5)


@query("s04_generation_scores",
       S.with_(_generated_sql()) + f""",
gp AS (SELECT pair_id, generated AS hyp, tgt AS ref FROM generated),
{chrf_ctes('gp', 'gc_')},
ga AS (SELECT pair_id, sum(CASE WHEN hyp > 0 AND ref > 0 THEN match / hyp ELSE 0 END) AS ps,
              sum(CASE WHEN hyp > 0 AND ref > 0 THEN match / ref ELSE 0 END) AS rs,
              sum(CASE WHEN hyp > 0 AND ref > 0 THEN 1 ELSE 0 END) AS k FROM gc_st GROUP BY pair_id)
SELECT g.pair_id, g.src, g.tgt AS reference, g.generated,
       round(coalesce({_fbeta_sql('ps', 'rs', 'k')}, 0.0), 2) AS chrf
FROM generated g LEFT JOIN ga USING (pair_id)""")
def s04_generation(spark, sf):
    """The full score table of the generation test split."""
    pairs = _split_stage(spark, sf)
    test = pairs.filter(F.col("split") == "test").select("pair_id", "src", "tgt")
    made = written(MD.generate(test, "pair_id", _lexicon(pairs), keep=["tgt"]), "generated")
    scores = O.sentence_chrf(made.select("pair_id", F.col("generated").alias("hyp"), F.col("tgt").alias("ref")))
    return made.join(scores, "pair_id").select("pair_id", "src", F.col("tgt").alias("reference"), "generated",
                                               F.round("chrf", 2).alias("chrf"))


# The evaluation job: one table of predictions, from which errors and report come.

def detection_evaluation(spark, sf):
    return evaluate_detection(spark, detection_examples(spark, sf), scratch_path(spark, "evaluation"))


@query("f05_evaluation_errors", ORACLE["f05_detection_errors"])
def f05_evaluation(spark, sf):
    return detection_evaluation(spark, sf)["errors"]


@query("a05_evaluation_report", ORACLE["m03_pair_classifier_report"])
def a05_evaluation(spark, sf):
    return detection_evaluation(spark, sf)["report"]

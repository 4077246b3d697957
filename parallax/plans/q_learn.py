"""Registered training and decoding queries: M4 by expectation-maximisation, M2 by beam
search, M3 as a trained head whose epoch log W1, W2, A3 and A12 read."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import arrays as V
from parallax.functions import text as T
from parallax.operators import align as EM
from parallax.operators import decode as D
from parallax.operators import head as H
from parallax.operators import metrics as M
from parallax.operators import models as MD
from parallax.operators import positional as G
from parallax.operators import runs as W
from parallax.plans import inputs as I
from parallax.plans import sqlfrag as S
from parallax.plans.q_sample import SPLIT, split_pairs
from parallax.plans.registry import query
from parallax.sources.io import written

EM_ROUNDS = 3  # of the registered queries, without a stop rule, as their SQL


# -- M4 -------------------------------------------------------------------------

def _em_sql(rounds: int) -> str:
    out = SPLIT + f""",
toks AS (SELECT pair_id, {S.tokens('src')} AS s, {S.tokens('tgt')} AS t FROM splits WHERE split = 'train'),
cells AS (SELECT pair_id, j, t[j] AS t, s[greatest(centre - {EM.BAND}, 1) : least(centre + {EM.BAND}, len(s))] AS ss
          FROM (SELECT *, CAST(ceil(j * len(s) / len(t)) AS BIGINT) AS centre
                FROM (SELECT *, unnest(range(1, len(t) + 1)) AS j FROM toks WHERE len(s) > 0 AND len(t) > 0))),
links AS MATERIALIZED (SELECT pair_id, j, t, len(ss) AS size, unnest(ss) AS s FROM cells),
e1 AS (SELECT s, t, 1 / size AS share, ln(1 / (SELECT count(DISTINCT t) FROM links)) / size AS ll FROM links)"""
    for i in range(1, rounds + 1):
        out += f""",
r{i} AS MATERIALIZED (SELECT s, t, sum(share) AS c, sum(ll) AS ll FROM e{i} GROUP BY s, t),
p{i} AS MATERIALIZED (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS p FROM r{i})"""
        if i < rounds:
            out += f""",
e{i + 1} AS (SELECT s, t, p / total AS share, ln(total / size) / size AS ll
       FROM (SELECT s, t, size, p, sum(p) OVER (PARTITION BY pair_id, j) AS total FROM links JOIN p{i} USING (s, t)))"""
    return out


def _ranked_sql(rounds: int, most: int) -> str:
    return f"""best AS (SELECT * FROM (
  SELECT s, t, p, row_number() OVER (PARTITION BY s ORDER BY round(p, 9) DESC, t) AS rank FROM p{rounds}) WHERE rank <= {most})"""


def train_cells(pairs):
    """The cells of the train pairs, linked within the band."""
    return EM.banded_cells(pairs.where("split = 'train'").select("pair_id", "src", "tgt"), "pair_id",
                           T.whitespace_tokens("src"), T.whitespace_tokens("tgt"))


@query("m04_em_step", S.with_(_em_sql(1)) + "SELECT s, t, round(p, 9) AS p FROM p1")
def m04_em_step(spark, sf):
    """One round from even probabilities."""
    return EM.train(train_cells(split_pairs(spark, sf)), rounds=1)[0].select("s", "t", F.round("p", 9).alias("p"))


@query("m04_em", S.with_(_em_sql(EM_ROUNDS), _ranked_sql(EM_ROUNDS, 1)) + "SELECT s, t, round(p, 9) AS p FROM best")
def m04_em(spark, sf):
    """The likeliest target of every source word after three rounds."""
    probs, _ = EM.train(train_cells(split_pairs(spark, sf)), EM_ROUNDS, tolerance=0)
    return EM.best_targets(probs).select("s", "t", F.round("p", 9).alias("p"))


@query("m04_em_log", S.with_(_em_sql(EM_ROUNDS)) + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS round, round(sum(ll), 6) AS log_likelihood FROM r{i}" for i in range(1, EM_ROUNDS + 1)))
def m04_em_log(spark, sf):
    """The log-likelihood that each round started from."""
    _, log = EM.train(train_cells(split_pairs(spark, sf)), EM_ROUNDS, tolerance=0)
    return spark.createDataFrame(log, "round bigint, log_likelihood double").withColumn(
        "log_likelihood", F.round("log_likelihood", 6))


# -- M2 -------------------------------------------------------------------------

def _beam_sql() -> str:
    penal = f"CASE WHEN list_contains(seq, t) THEN CASE WHEN x < 0 THEN x * {K.REPETITION_PENALTY!r} ELSE x / {K.REPETITION_PENALTY!r} END ELSE x END"
    return _em_sql(EM_ROUNDS) + ",\n" + _ranked_sql(EM_ROUNDS, D.CANDIDATES) + f""",
tt AS (SELECT {S.tokens('tgt')} AS t FROM splits WHERE split = 'train'),
bg AS (SELECT t[i] AS v, t[i + 1] AS w FROM (SELECT t, unnest(range(1, len(t))) AS i FROM tt)),
cvw AS (SELECT v, w, count(*) AS c_vw FROM bg GROUP BY v, w),
cv AS (SELECT v, count(*) AS c_v FROM bg GROUP BY v),
vs AS (SELECT count(DISTINCT tok) + 1 AS n FROM (SELECT unnest(t) AS tok FROM tt)),
words AS (SELECT pair_id, i, tk[i] AS tok FROM (SELECT pair_id, tk, unnest(range(1, len(tk) + 1)) AS i
          FROM (SELECT pair_id, {S.tokens('src')} AS tk FROM splits WHERE split = 'test'))),
cand AS MATERIALIZED (SELECT pair_id, i, coalesce(t, tok) AS t, coalesce(ln(p), 0.0) AS lp FROM words LEFT JOIN best ON s = tok),
near AS (SELECT DISTINCT a.t AS v, b.t AS w FROM cand a JOIN cand b ON a.pair_id = b.pair_id AND b.i = a.i + 1),
lm AS MATERIALIZED (SELECT v, w, ln((coalesce(c_vw, 0) + {MD.ADD_K!r}) / (coalesce(c_v, 0) + {MD.ADD_K!r} * vs.n)) AS lq
       FROM near LEFT JOIN cvw USING (v, w) LEFT JOIN cv USING (v) CROSS JOIN vs),
beam AS (
  SELECT pair_id, CAST(1 AS BIGINT) AS i, [t] AS seq, lp AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(lp, {D.DIGITS}) DESC, t) AS r FROM cand WHERE i = 1)
  WHERE r <= {D.WIDTH}
  UNION ALL
  SELECT pair_id, i, seq, score FROM (
    SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, {D.DIGITS}) DESC, seq) AS r FROM (
      SELECT pair_id, i, list_append(seq, t) AS seq, score + {penal} AS score FROM (
        SELECT b.pair_id, c.i, b.seq, b.score, c.t, c.lp + lm.lq AS x
        FROM beam b JOIN cand c ON c.pair_id = b.pair_id AND c.i = b.i + 1 JOIN lm ON lm.v = b.seq[-1] AND lm.w = c.t)))
  WHERE r <= {D.WIDTH}),
last AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, {D.DIGITS}) DESC, seq) AS r
         FROM beam JOIN (SELECT pair_id, max(i) AS i FROM words GROUP BY pair_id) USING (pair_id, i))"""


@query("m02_beam", "WITH RECURSIVE " + _beam_sql() + """
SELECT s.pair_id, coalesce(array_to_string(seq, ' '), '') AS generated, round(coalesce(score, 0.0), 6) AS score
FROM (SELECT pair_id FROM splits WHERE split = 'test') s LEFT JOIN (SELECT * FROM last WHERE r = 1) l ON s.pair_id = l.pair_id""")
def m02_beam(spark, sf):
    """Beam search over the learned lexicon and a bigram model of the train targets."""
    pairs = written(split_pairs(spark, sf), "splits")
    probs, _ = EM.train(train_cells(pairs), EM_ROUNDS, tolerance=0)
    lm = MD.BigramLM.fit(pairs.where("split = 'train'").select(T.whitespace_tokens("tgt").alias("t")), "t")
    test = pairs.where("split = 'test'").select("pair_id", T.whitespace_tokens("src").alias("tokens"))
    found = D.beam_search(test, "pair_id", "tokens", EM.best_targets(probs, D.CANDIDATES), lm)
    return found.select("pair_id", F.col("text").alias("generated"), F.round("score", 6).alias("score"))


# -- M3 -------------------------------------------------------------------------

CLASSES, EPOCHS, RATE = 10, 8, 0.5


def split_embeddings(spark, sf):
    emb = I.table(spark, sf, "embeddings").select("vec_id", "label", F.transform(
        "embedding", lambda x: x.cast("double")).alias("h"))
    return written(G.split_dataset(emb, "vec_id"), "embedding-splits")


def trained_head(rows) -> H.TrainedHead:
    return H.train(rows, "h", "label", CLASSES, I.DIMENSIONS, EPOCHS, RATE)


def _head_sql() -> str:
    n_temp = "CAST(ceil((1 - 0.8::DOUBLE) * n) AS BIGINT)"
    n_test = "CAST(ceil(0.5::DOUBLE * ceil((1 - 0.8::DOUBLE) * n)) AS BIGINT)"
    out = f"""ranked AS (
  SELECT vec_id, CAST(label AS INTEGER) AS y, embedding, count(*) OVER () AS n,
         row_number() OVER (ORDER BY {S.rkey('vec_id')}, vec_id) - 1 AS pos FROM embeddings),
rows AS MATERIALIZED (
  SELECT vec_id, y, embedding, CASE WHEN pos < n - {n_temp} THEN 'train' WHEN pos < n - {n_test} THEN 'dev' ELSE 'test' END AS split,
         pos - CASE WHEN pos < n - {n_temp} THEN 0 WHEN pos < n - {n_test} THEN n - {n_temp} ELSE n - {n_test} END AS split_pos
  FROM ranked),
x AS MATERIALIZED (
  SELECT vec_id, split, y, unnest(range(0, {I.DIMENSIONS + 1})) AS d,
         unnest(list_append(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), 1.0)) AS v FROM rows),
classes AS (SELECT unnest(range(0, {CLASSES})) AS k),
w0 AS (SELECT k, d, 0.0::DOUBLE AS w FROM classes, (SELECT unnest(range(0, {I.DIMENSIONS + 1})) AS d))"""
    for e in range(EPOCHS + 1):
        out += f""",
z{e} AS MATERIALIZED (SELECT vec_id, split, y, k, sum(v * w) AS z FROM x JOIN w{e} USING (d) GROUP BY ALL),
m{e} AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mx FROM z{e}),
s{e} AS MATERIALIZED (SELECT *, exp(z - mx) / sum(exp(z - mx)) OVER (PARTITION BY vec_id) AS p,
         mx + ln(sum(exp(z - mx)) OVER (PARTITION BY vec_id)) AS lse FROM m{e}),
l{e} AS (SELECT vec_id, split, any_value(y) AS y, max(lse - z) FILTER (k = y) AS loss, min(k) FILTER (z = mx) AS pred,
         max(p) AS confidence FROM s{e} GROUP BY vec_id, split)"""
        if e < EPOCHS:
            out += f""",
w{e + 1} AS MATERIALIZED (
  SELECT k, d, any_value(w) - {RATE!r}::DOUBLE * sum((p - CASE WHEN k = y THEN 1 ELSE 0 END) * v)
         / (SELECT count(*) FROM rows WHERE split = 'train') AS w
  FROM (SELECT vec_id, k, y, p FROM s{e} WHERE split = 'train') JOIN (SELECT vec_id, d, v FROM x) USING (vec_id)
       JOIN w{e} USING (k, d) GROUP BY k, d)"""
    log = " UNION ALL ".join(f"""SELECT 'head' AS run, CAST({e} AS BIGINT) AS epoch,
    (SELECT avg(loss) FROM l{e - 1} WHERE split = 'train') AS train_loss,
    (SELECT avg(loss) FROM l{e} WHERE split = 'dev') AS dev_loss,
    (SELECT avg(CAST(pred = y AS DOUBLE)) FROM l{e} WHERE split = 'dev') AS dev_acc""" for e in range(1, EPOCHS + 1))
    from parallax.plans.q_runs import _marks_sql
    marks = _marks_sql().split(S.EVT_LOGS + ",\n", 1)[1]
    every = " UNION ALL ".join(f"SELECT {e} AS epoch, vec_id, y, split, loss, pred, confidence FROM l{e}" for e in range(1, EPOCHS + 1))
    return out + f""",
logs AS ({log}),
{marks},
epochs AS (SELECT * FROM marks WHERE kept),
chosen AS (SELECT CAST(last_improved AS BIGINT) AS best_epoch, best_so_far AS best_value,
                  CASE WHEN stop_hit = 1 THEN CAST(epoch AS BIGINT) END AS stop_epoch, CAST(epoch AS BIGINT) AS epochs_run
           FROM epochs ORDER BY epoch DESC LIMIT 1),
test AS (SELECT e.*, split_pos FROM ({every}) e JOIN rows USING (vec_id) JOIN chosen ON e.epoch = best_epoch WHERE e.split = 'test')"""


@query("m03_trained_head", S.with_(_head_sql()) + """
SELECT vec_id, y AS gold, CAST(pred AS INTEGER) AS pred, confidence, loss FROM test""")
def m03_trained_head(spark, sf):
    """The test rows as the best epoch's head scores them."""
    return scored_test(split_embeddings(spark, sf))[0].select("vec_id", "gold", "pred", "confidence", "loss")


def scored_test(rows):
    trained = trained_head(rows)
    test = rows.where("split = 'test'").select("vec_id", "split_pos", F.col("label").cast("int").alias("gold"),
                                               F.explode(F.array(trained.logits(F.col("h")))).alias("logits"))
    return test.select("vec_id", "split_pos", "gold", V.argmax("logits").alias("pred"),
                       F.array_max(V.softmax("logits")).alias("confidence"),
                       V.cross_entropy("logits", "gold").alias("loss")), trained


@query("m03_head_log", S.with_(_head_sql()) + """
SELECT epoch, train_loss, dev_loss, dev_acc, improved, no_improve FROM epochs""")
def m03_head_log(spark, sf):
    """The epochs that were run, as early stopping judged them."""
    log = trained_head(split_embeddings(spark, sf)).log
    marks = W.mark_epochs(log).select("epoch", "improved", "no_improve")
    return log.join(marks, "epoch").select("epoch", "train_loss", "dev_loss", "dev_acc", "improved", "no_improve")


@query("m03_head_report", S.with_(_head_sql()) + f"""
SELECT best_epoch, best_value, stop_epoch, epochs_run, (SELECT avg(CAST(pred = y AS DOUBLE)) FROM test) AS accuracy,
       (SELECT avg(b) FROM (SELECT avg(loss) AS b FROM test GROUP BY floor(split_pos / {K.GEN_BATCH_SIZE}))) AS test_loss
FROM chosen""")
def m03_head_report(spark, sf):
    """The checkpoint that was kept (W1), its accuracy (A3) and loss as a mean of batch means."""
    scored, trained = scored_test(split_embeddings(spark, sf))
    scored = written(scored, "head-scores")
    accuracy = M.accuracy(scored.select("pred", "gold")).select("accuracy").scalar()
    loss = M.mean_of_batch_means(scored.select("split_pos", F.col("loss").alias("row_loss")), "split_pos",
                                 K.GEN_BATCH_SIZE).select("loss").scalar()
    return trained.checkpoint.select("best_epoch", "best_value", "stop_epoch", "epochs_run",
                                     accuracy.alias("accuracy"), loss.alias("test_loss"))

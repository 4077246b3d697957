"""Model jobs re-aimed as Spark jobs (M1-M6).

* M5 bigram language model: counts from the train split, add-k smoothing,
  row loss = mean negative log-probability of a row's bigrams.
* M4 lexicon translator: source word i is aligned to target word
  ceil(i * m / n) (diagonal alignment, linear in sentence length - no
  all-pairs expansion); the lexicon keeps the most frequent target per
  source word; translation maps each token and keeps the order.
* M3 pair classifier: naive Bayes over the tokens of both sides and their shared
  tokens, from grouped counts; ``pyspark.ml`` logistic regression is an option.
* M1/M2: batch scoring harnesses; M6: untrained baselines on the same inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from parallax.functions import text as T
from parallax.operators import rerank as R
from parallax.operators.curate import evaluated_once
from parallax.sources.io import scratch_path, written

ADD_K = 0.1
OVERLAP_THRESHOLD = 0.5


# M5 --------------------------------------------------------------------------

def _bigrams(tokens: Column) -> Column:
    """array<struct<i, v, w>>: left index i (1-based), left token v, right token w."""
    return F.when(F.size(tokens) >= 2, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - 1),
        lambda i: F.struct(i.alias("i"), F.element_at(tokens, i).alias("v"),
                           F.element_at(tokens, i + 1).alias("w")))
    ).otherwise(F.array().cast("array<struct<i:int,v:string,w:string>>"))


class BigramLM:
    """Add-k bigram model fitted on a token-array column (all Spark tables)."""

    def __init__(self, pair_counts: DataFrame, context_counts: DataFrame, vocab_size: Column,
                 k: float = ADD_K):
        self.pair_counts, self.context_counts = pair_counts, context_counts
        self.vocab_size, self.k = vocab_size, k

    @classmethod
    def fit(cls, train: DataFrame, tokens: str, k: float = ADD_K) -> "BigramLM":
        bg = train.select(F.explode(_bigrams(F.col(tokens))).alias("b")).select("b.v", "b.w")
        pair_counts = bg.groupBy("v", "w").agg(F.count(F.lit(1)).alias("c_vw"))
        context_counts = bg.groupBy("v").agg(F.count(F.lit(1)).alias("c_v"))
        # Distinct training tokens + 1 for unseen words, as a scalar subquery.
        vsize = train.select(F.explode(tokens).alias("t")).groupBy("t").count().agg(
            (F.count(F.lit(1)) + 1).alias("n")).scalar()
        return cls(pair_counts, context_counts, vsize, k)

    def row_loss(self, df: DataFrame, keys: str | Sequence[str], tokens: str,
                 from_index: Column | None = None) -> DataFrame:
        """(keys, row_loss, n_scored): mean -log p over the row's bigrams; with
        ``from_index`` only bigrams whose right token index (1-based) is
        greater than it are scored (target-only loss)."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        ex = df.select(*keys, *([from_index.alias("_from")] if from_index is not None else []),
                       F.explode(_bigrams(F.col(tokens))).alias("b"))
        if from_index is not None:
            ex = ex.filter(F.col("b.i") >= F.col("_from"))
        ex = ex.select(*keys, F.col("b.v").alias("v"), F.col("b.w").alias("w"))
        return self.log_probability(ex, "_lp").groupBy(*keys).agg(
            F.avg(-F.col("_lp")).alias("row_loss"), F.count(F.lit(1)).alias("n_scored"))

    def log_probability(self, pairs: DataFrame, out: str) -> DataFrame:
        """pairs with columns v and w, and the log probability of w after v."""
        j = pairs.join(self.pair_counts, ["v", "w"], "left").join(self.context_counts, ["v"], "left")
        p = ((F.coalesce("c_vw", F.lit(0)) + self.k)
             / (F.coalesce("c_v", F.lit(0)) + self.k * self.vocab_size))
        return j.withColumn(out, F.log(p)).drop("c_vw", "c_v")


# M4 --------------------------------------------------------------------------

def _aligned_pairs(src: Column, tgt: Column) -> Column:
    n, m = F.size(src), F.size(tgt)
    return F.when((n > 0) & (m > 0), F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(F.element_at(src, i).alias("s"),
                           F.element_at(tgt, F.ceil(i * m / n).cast("int")).alias("t")))
    ).otherwise(F.array().cast("array<struct<s:string,t:string>>"))


def aligned_counts(train: DataFrame, src_tokens: str, tgt_tokens: str) -> DataFrame:
    """(s, t, count) of all aligned word pairs."""
    pairs = train.select(F.explode(_aligned_pairs(F.col(src_tokens), F.col(tgt_tokens))).alias("p"))
    return pairs.groupBy("p.s", "p.t").agg(F.count(F.lit(1)).alias("count"))


def train_lexicon(train: DataFrame, src_tokens: str, tgt_tokens: str) -> DataFrame:
    """(s, t, count): most frequent aligned target per source word (ties: smallest t)."""
    counts = aligned_counts(train, src_tokens, tgt_tokens)
    best = counts.groupBy("s").agg(F.min(F.struct((-F.col("count")).alias("nc"), "t")).alias("m"))
    return best.select("s", F.col("m.t").alias("t"), (-F.col("m.nc")).alias("count"))


def reranked_lexicon(counts: DataFrame) -> DataFrame:
    """(s, t): one target per source word drawn by W6 > W3 > W4 > W5 > pick from all its aligned
    targets, with the log of the count as logit; a target that echoes its source counts as seen."""
    cands = counts.select(F.col("s").alias(R.G), F.col("t").alias(R.C), F.log("count").alias("logit"))
    echoes = cands.filter(F.col(R.G) == F.col(R.C)).select(R.G, R.C)
    return R.rerank(cands, echoes).select(F.col(R.G).alias("s"), F.col(R.C).alias("t"))


def translate(df: DataFrame, key: str, tokens: str, lexicon: DataFrame, out: str = "translation",
              keep: Sequence[str] = ()) -> DataFrame:
    """Token-by-token lexicon translation (unknown words copied), order kept.

    ``keep`` names columns that come back beside the key. They ride on the row's
    first token only, so nothing is joined back to the input.
    """
    ex = df.select(key, F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"),
                   F.posexplode_outer(tokens).alias("pos", "tok"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    ex = ex.withColumn("_keep", F.when(first, F.col("_keep"))) if keep else ex.drop("_keep")
    lx = lexicon.select(F.col("s").alias("_s"), F.col("t").alias("_t"))
    j = ex.join(lx, ex.tok == lx._s, "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("_t", "tok").alias("w")))
    kept = [F.first("_keep", ignorenulls=True).alias("_keep")] if keep else []
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_a"), *kept)
    return g.select(key, *[F.col("_keep")[c].alias(c) for c in keep],
                    F.array_join(F.col("_a")["w"], " ").alias(out))


# M6 --------------------------------------------------------------------------

def token_overlap(a: Column, b: Column) -> Column:
    """|distinct shared tokens| / |distinct tokens of a| (0 for an empty a)."""
    da = F.array_distinct(a)
    return F.when(F.size(da) > 0, F.size(F.array_intersect(da, b)) / F.size(da)).otherwise(0.0)


def overlap_detector(df: DataFrame, src: str = "src", tgt: str = "tgt",
                     threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Untrained detection baseline: predict 1 when enough source tokens reappear."""
    score = token_overlap(T.whitespace_tokens(src), T.whitespace_tokens(tgt))
    return df.withColumn("score", score).withColumn("pred", (F.col("score") >= threshold).cast("int"))


def echo_generator(df: DataFrame, src: str = "src", out: str = "generated") -> DataFrame:
    """Untrained generation baseline: the source is the output."""
    return df.withColumn(out, F.col(src))


# M3 --------------------------------------------------------------------------

def pair_features(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Prefixed token bags: source words, target words, shared words, and how many are shared."""
    s, t = T.whitespace_tokens(src), T.whitespace_tokens(tgt)
    shared = F.array_intersect(s, t)
    feats = F.concat(F.transform(s, lambda x: F.concat(F.lit("s:"), x)),
                     F.transform(t, lambda x: F.concat(F.lit("t:"), x)),
                     F.transform(shared, lambda x: F.concat(F.lit("x:"), x)),
                     F.array(F.concat(F.lit("n:"), F.size(shared).cast("string"))))
    return df.withColumn("features_raw", feats)


SMOOTHING = 1.0


class TokenLogOdds:
    """Pair classifier from grouped counts (naive Bayes over ``pair_features``): the
    log odds of label 1 are the sum of its features' log odds."""

    def __init__(self, counts: DataFrame, totals: DataFrame, smoothing: float = SMOOTHING):
        self.counts, self.totals, self.smoothing = counts, totals, smoothing

    @classmethod
    def fit(cls, examples: DataFrame, smoothing: float = SMOOTHING) -> "TokenLogOdds":
        feats = pair_features(examples).select("label", F.explode("features_raw").alias("feature"))
        # written: three totals and the scores read it, each of which would count the features again
        counts = written(feats.groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("c1"),
                                                      F.count_if(F.col("label") == 0).alias("c0")), "feature-counts")
        totals = counts.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.count(F.lit(1)).alias("v"))
        return cls(counts, totals, smoothing)

    def score(self, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
        """(key, keep, log_odds); features never seen in training are even."""
        a = self.smoothing
        n1, n0, v = (self.totals.select(c).scalar() for c in ("n1", "n0", "v"))
        odds = self.counts.select(F.col("feature").alias("_f"), (
            F.log((F.col("c1") + a) / (n1 + a * v)) - F.log((F.col("c0") + a) / (n0 + a * v))).alias("_odds"))
        # texts stay out of the feature rows: a hash of them tells equal keys' rows apart there
        wide = [c for c in keep if not isinstance(df.schema[c].dataType, (NumericType, BooleanType))]
        narrow = [c for c in keep if c not in wide]
        rows = df.withColumn("_text", F.xxhash64(*wide)) if wide else df
        ids = [key, *narrow, *(["_text"] if wide else [])]
        ex = pair_features(rows).select(*ids, F.explode("features_raw").alias("_x"))
        even = F.log(F.lit(a) / (n1 + a * v)) - F.log(F.lit(a) / (n0 + a * v))
        sums = (ex.join(odds, F.col("_x") == F.col("_f"), "left")
                .groupBy(*ids).agg(F.sum(F.coalesce("_odds", even)).alias("log_odds")))
        if not wide:
            return sums.select(key, *keep, "log_odds")
        sums = sums.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(ids)], "log_odds")
        same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(ids)]
        return (rows.select(*ids, *wide).join(sums, same).groupBy(*ids, *wide)
                .agg(F.max("log_odds").alias("log_odds")).select(key, *keep, "log_odds"))


def judged(scored: DataFrame) -> DataFrame:
    """log_odds > pred, label_pred and the confidence of the prediction (4 decimals)."""
    pred = (F.col("log_odds") > 0).cast("int")
    return (scored.withColumn("pred", pred).withColumn("label_pred", T.label_name(F.col("pred")))
            .withColumn("confidence", F.round(1 / (1 + F.exp(-F.abs("log_odds"))), 4)))


def train_pair_classifier(examples: DataFrame, reg_params: Sequence[float] = (0.0, 0.01, 0.1),
                          num_features: int = 1 << 18, max_iter: int = 50):
    """The option to ``TokenLogOdds``: fit one logistic regression per regularisation value on the train split, keep the
    one with the best dev accuracy (first wins ties). Returns (model, dev_acc)."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    data = pair_features(examples).withColumn("label_d", F.col("label").cast("double"))
    train = data.filter(F.col("split") == "train")
    dev = data.filter(F.col("split") == "dev")
    best, best_acc = None, -1.0
    for reg in reg_params:
        pipe = Pipeline(stages=[
            HashingTF(inputCol="features_raw", outputCol="features", numFeatures=num_features),
            LogisticRegression(featuresCol="features", labelCol="label_d", regParam=reg,
                               maxIter=max_iter)])
        # reread without its training summary, which holds the session: tasks can't take that once the session observes rows
        path = scratch_path(examples.sparkSession, "pair-classifier")
        pipe.fit(train).write().save(path)
        model = PipelineModel.load(path)
        acc = (model.transform(dev)
               .agg(F.avg((F.col("prediction") == F.col("label_d")).cast("double"))).first()[0])
        if acc is not None and acc > best_acc:
            best, best_acc = model, acc
    return best, best_acc


# M1 / M2 ---------------------------------------------------------------------

def overlap_logits(src: str = "src", tgt: str = "tgt") -> Column:
    """Class logits [incorrect, correct] of the token-overlap baseline."""
    score = token_overlap(T.whitespace_tokens(src), T.whitespace_tokens(tgt))
    return F.array(1 - score, score)


def length_logits_loader():
    """An example of a model loader for ``predict_batch_udf``: called once per executor
    Python process, it returns a function from numpy batches of (src, tgt) to class logits
    [incorrect, correct]; this one compares the lengths of both texts, array by array."""
    import numpy as np

    def predict(src, tgt):
        a, b = (np.char.str_len(np.where(x == None, "", x).astype(str)) for x in (src, tgt))  # noqa: E711
        score = np.minimum(a, b) / np.maximum(np.maximum(a, b), 1)
        return np.stack((1.0 - score, score), axis=1)
    return predict


def score_detection(df: DataFrame, model=None, loader: Callable | None = None) -> DataFrame:
    """Batch detection over a table: the native overlap scorer by default, a fitted
    pipeline's ``transform``, or a vectorised model from ``loader`` (called once per
    executor process through ``predict_batch_udf``) returning class logits."""
    if model is None:
        from parallax.functions.arrays import detection_result
        logits = overlap_logits()
        if loader is not None:
            from pyspark.ml.functions import predict_batch_udf
            from pyspark.sql.types import ArrayType, DoubleType
            predict = predict_batch_udf(loader, return_type=ArrayType(DoubleType()), batch_size=256)
            logits = predict(F.col("src"), F.col("tgt"))
        out = evaluated_once(df, {"logits": logits})
        r = out.withColumn("_r", detection_result("logits"))
        return r.withColumn("label_pred", F.col("_r.label")).withColumn(
            "confidence", F.col("_r.confidence")).drop("_r")
    scored = model.transform(pair_features(df))
    from pyspark.ml.functions import vector_to_array
    probs = vector_to_array("probability")
    return (scored.withColumn("pred", F.col("prediction").cast("int"))
            .withColumn("label_pred", T.label_name(F.col("pred")))
            .withColumn("confidence", F.round(F.array_max(probs), 4))
            .drop("features_raw", "features", "rawPrediction", "probability", "prediction"))


def generate(df: DataFrame, key: str, lexicon: DataFrame, src: str = "src",
             out: str = "generated", keep: Sequence[str] = ()) -> DataFrame:
    """Batch generation: prompt > lexicon translation > completion post-process.
    Returns the key, the source, ``keep`` and ``out``; one regroup by key, no join back."""
    kept = [src, *[c for c in keep if c != src]]
    toks = df.select(key, *kept, T.whitespace_tokens(src).alias("_toks"))
    tr = translate(toks, key, "_toks", lexicon, "_tr", kept)
    prompt = tr.withColumn("_prompt", T.generation_prompt(src, quoted=True))
    return prompt.withColumn(out, T.postprocess_completion(
        F.concat("_prompt", "_tr"), F.col("_prompt"))).drop("_prompt", "_tr")

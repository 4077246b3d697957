"""M1/M3 harnesses: the pluggable vectorised loader and the pyspark.ml classifier."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from parallax.operators import models as MD


def test_score_detection_with_loader(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a b c", "x y z")], "example_id long, src string, tgt string")
    df = df.unionByName(spark.createDataFrame([(3, None, "long text"), (4, "x", "y" * 9)], df.schema))
    out = {r.example_id: r for r in MD.score_detection(df, loader=MD.length_logits_loader).collect()}
    assert out[1].label_pred == "correct" and out[1].confidence == 0.7311  # softmax([0, 1])
    assert out[3].label_pred == "incorrect" and out[4].label_pred == "incorrect"


def test_score_detection_native(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a b c", "x y z"), (3, None, "None")],
                               "example_id long, src string, tgt string")
    out = {r.example_id: r for r in MD.score_detection(df).collect()}
    assert out[1].label_pred == "correct" and out[1].confidence == 0.7311
    assert out[2].label_pred == "incorrect" and out[3].label_pred == "incorrect"  # a null is no token


def test_pair_classifier_learns_overlap(spark):
    rows = []
    for i in range(400):
        words = [f"w{(i * 7 + k) % 50}" for k in range(6)]
        other = [f"w{(i * 13 + k + 25) % 50}" for k in range(6)]
        split = "train" if i < 300 else ("dev" if i < 350 else "test")
        rows.append((split, i * 2 + 1, " ".join(words), " ".join(words), 1))
        rows.append((split, i * 2, " ".join(words), " ".join(other), 0))
    ex = spark.createDataFrame(rows, "split string, example_id long, src string, tgt string, label int")
    lo = MD.judged(MD.TokenLogOdds.fit(ex.filter("split = 'train'")).score(
        ex.filter("split = 'test'"), "example_id", ["label"]))
    assert lo.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0] > 0.9
    model, dev_acc = MD.train_pair_classifier(ex, reg_params=(0.01,), num_features=1 << 12, max_iter=20)
    scored = MD.score_detection(ex.filter(F.col("split") == "test"), model)
    acc = scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert dev_acc > 0.9 and acc > 0.9


def test_pair_classifier_scores_in_a_session_that_observes(spark):
    """The session's observations don't go to tasks, and so no fitted model may hold the session."""
    seen = Observation()
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get["n"] == 3
    rows = [(("train", "dev")[i % 5 == 0], i, f"w{i} w{i + 1}", f"w{i} w{i + 1}" if i % 2 else "z", i % 2) for i in range(40)]
    ex = spark.createDataFrame(rows, "split string, example_id long, src string, tgt string, label int")
    model, dev_acc = MD.train_pair_classifier(ex, reg_params=(0.01,), num_features=1 << 8, max_iter=5)
    assert dev_acc > 0.5 and MD.score_detection(ex, model).count() == 40


def test_texts_stay_out_of_the_feature_rows(spark):
    """Kept texts come back by the key; rows of one key that differ in any kept column stay apart."""
    train = spark.createDataFrame([("a b", "a c", 1), ("a b", "x y", 0), ("c d", "d c", 1)], "src string, tgt string, label int")
    rows = [("k", 1, "a b", "a c"), ("k", 1, "a b", "a c"), ("k", 1, "a b", "q"), ("k", 0, "a b", "q"), (None, 1, "c", "c"), ("n", 1, None, "c")]
    df = spark.createDataFrame(rows, "id string, label int, src string, tgt string")
    model = MD.TokenLogOdds.fit(train)
    got = model.score(df, "id", ["label", "src", "tgt"])
    assert got.columns == ["id", "label", "src", "tgt", "log_odds"]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = next(i for i, line in enumerate(plan) if "Join LeftOuter, (_x#" in line)
    assert "_odds#" in plan[met - 1] and "src#" not in plan[met - 1]  # what the feature rows are summed up with
    once = {r[0]: r.log_odds for r in model.score(spark.createDataFrame(
        [(f"{s}|{t}", s, t) for s, t in [("a b", "a c"), ("a b", "q"), ("c", "c")]], "id string, src string, tgt string"), "id").collect()}
    want = [(None, 1, "c", "c", once["c|c"]), ("k", 0, "a b", "q", once["a b|q"]), ("k", 1, "a b", "a c", 2 * once["a b|a c"]),
            ("k", 1, "a b", "q", once["a b|q"])]
    assert sorted(((r.id, r.label, r.src, r.tgt, round(r.log_odds, 9)) for r in got.collect()), key=str) == \
        sorted(((*w[:4], round(w[4], 9)) for w in want), key=str)

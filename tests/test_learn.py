"""Training and decoding: EM against a plain Model 1, beams against all outputs, descent against numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.operators import align as EM
from parallax.operators import decode as D
from parallax.operators import head as H
from parallax.operators import models as MD
from parallax.operators import runs as W

PAIRS = [("a b c", "x y z"), ("a c", "x z"), ("b b a", "y y x"), ("c", "z z z z"), ("a b c d e", "v"), ("", "x"), ("a", ""),
         (None, "x"), ("d e", "u v w"), ("e a d", "w x u u")]


def links(spark, band):
    df = spark.createDataFrame([(i, s.split() if s is not None else None, t.split()) for i, (s, t) in enumerate(PAIRS)],
                               "id long, s array<string>, t array<string>")
    return EM.banded_links(df, "id", F.col("s"), F.col("t"), band)


def model_one(rounds, band):
    """(probabilities, log-likelihood before each round) in plain Python."""
    cells = []
    for s, t in PAIRS:
        s, t = (s or "").split(), t.split()
        for j, word in enumerate(t, 1):
            centre = math.ceil(j * len(s) / len(t))
            near = s[max(centre - band, 1) - 1:centre + band] if s else []
            if near:
                cells.append((near, word))
    targets = {t for _, t in cells}
    p = {(s, t): 1 / len(targets) for near, t in cells for s in near}
    log = []
    for _ in range(rounds):
        counts, total = {}, {}
        log.append(0.0)
        for near, t in cells:
            z = sum(p[s, t] for s in near)
            log[-1] += math.log(z / len(near))
            for s in near:
                counts[s, t] = counts.get((s, t), 0) + p[s, t] / z
                total[s] = total.get(s, 0) + p[s, t] / z
        p = {(s, t): c / total[s] for (s, t), c in counts.items()}
    return p, log


@pytest.mark.parametrize("band", [0, 1, 50])
def test_em_is_model_one_within_its_band(spark, band):
    """A band as wide as the sentence is Model 1."""
    got, log = EM.train(links(spark, band), rounds=4, tolerance=0)
    want, likelihoods = model_one(4, band)
    assert {(r.s, r.t): round(r.p, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert [round(x, 9) for _, x in log] == [round(x, 9) for x in likelihoods]
    assert all(b >= a - 1e-12 for a, b in zip(likelihoods, likelihoods[1:]))
    if band == 50:
        whole = sum(len(s.split()) * len(t.split()) for s, t in PAIRS if s)
        assert links(spark, band).count() == whole


def test_em_stops_by_itself(spark):
    seen = []
    _, log = EM.train(links(spark, 1), rounds=40, tolerance=0.01, on_round=lambda i, x: seen.append((i, x)))
    assert seen == log and 2 < len(log) < 40
    gains = [(b - a) / abs(a) for (_, a), (_, b) in zip(log, log[1:])]
    assert gains[-1] < 0.01 <= min(gains[:-1])
    empty = spark.createDataFrame([], "id long, s array<string>, t array<string>")
    probs, log = EM.train(EM.banded_links(empty, "id", F.col("s"), F.col("t")), rounds=3)
    assert probs.count() == 0 and log[0] == (1, 0.0)


@pytest.mark.parametrize("chunk", [1, 7])
def test_em_does_not_depend_on_its_chunks(spark, chunk):
    """Small chunks share target words and so exchange their pairs' counts; each pair is listed once."""
    got, log = EM.train(links(spark, 1).repartition(5), rounds=4, tolerance=0, chunk=chunk)
    want, likelihoods = model_one(4, 1)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.s, r.t): round(r.p, 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}
    assert [round(x, 9) for _, x in log] == [round(x, 9) for x in likelihoods]


def test_em_cells_of_one_key_are_one(spark):
    """Rows of one key share out a target position together, whatever their texts, sizes and words, as the SQL does."""
    pairs = [(1, "a b", "x y"), (1, "a b", "x y"), (1, "c", "z"), (2, "a c d", "y z"), (2, "d", "y"), (3, "b", "x")]
    df = spark.createDataFrame([(k, s.split(), t.split()) for k, s, t in pairs], "id long, s array<string>, t array<string>")
    cells, targets = {}, set()
    for k, s, t in [(k, s.split(), t.split()) for k, s, t in pairs]:
        for j, word in enumerate(t, 1):
            centre = math.ceil(j * len(s) / len(t))
            near = s[max(centre - 1, 1) - 1:centre + 1]
            cells.setdefault((k, j), []).extend((x, word, len(near)) for x in near)
            targets.add(word)
    p, log = None, []
    for _ in range(3):
        counts, ll = {}, 0.0
        for cell in cells.values():
            z = sum(p[s, t] for s, t, _ in cell) if p else 0
            for s, t, n in cell:
                counts[s, t] = counts.get((s, t), 0) + (p[s, t] / z if p else 1 / n)
                ll += (math.log(z / n) if p else -math.log(len(targets))) / n
        whole = {}
        for (s, _), c in counts.items():
            whole[s] = whole.get(s, 0) + c
        p = {(s, t): c / whole[s] for (s, t), c in counts.items()}
        log.append(ll)
    for chunk in (2, EM.CHUNK):
        got, found = EM.train(EM.banded_links(df, "id", F.col("s"), F.col("t"), 1), rounds=3, tolerance=0, chunk=chunk)
        assert {(r.s, r.t): round(r.p, 9) for r in got.collect()} == {k: round(v, 9) for k, v in p.items()}
        assert [round(x, 9) for _, x in found] == [round(x, 9) for x in log]


def test_em_rounds_exchange_sums_not_links(spark):
    """Between chunks go sums per word, not links or pairs; chunks and counts meet without an exchange."""
    rng = random.Random(5)
    rows = [(i, rng.choices("abcdefghijklmnopqrst", k=40), [rng.choice("uvwxyz") + str(rng.randrange(40)) for _ in range(40)]) for i in range(200)]
    every = EM.banded_links(spark.createDataFrame(rows, "id long, s array<string>, t array<string>"), "id", F.col("s"), F.col("t"))
    chunks = EM.chunks_of(every)
    whole = every.count()
    assert chunks.agg(F.sum(F.size("link"))).first()[0] == whole
    counts = EM._kept(chunks.mapInArrow(lambda b: EM._counted(b, 240), EM._COUNTS), "counts")
    for threshold in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            counted = chunks.join(counts.select("chunk", "counts"), "chunk")
            parts = EM.part_sums(counted)
            assert parts.count() < 20 * 2 * chunks.count() + whole / 10
            if threshold == "-1":
                plan = parts._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange") == 1 and "shared" in plan.split("Exchange")[1]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_em_rounds_exchange_no_words(spark):
    """A round's sums are numbers alone, a row a part; what they stand for is dealt out once, and is not exchanged again."""
    rng = random.Random(7)
    rows = [(i, rng.choices("abcdefghijklmnopqrst", k=9), [rng.choice("xyz") + str(rng.randrange(6)) for _ in range(9)]) for i in range(60)]
    every = EM.banded_links(spark.createDataFrame(rows, "id long, s array<string>, t array<string>"), "id", F.col("s"), F.col("t"))
    chunks = EM.chunks_of(every, 300)
    places = EM.places_of(chunks)
    counts = EM._kept(chunks.mapInArrow(lambda b: EM._counted(b, 18), EM._COUNTS), "counts")
    counted = chunks.join(counts.select("chunk", "counts"), "chunk")
    parts = EM.part_sums(counted)
    assert dict(parts.dtypes) == {"part": "int", "chunk": "bigint", "c": "array<double>"}
    kept = {r.chunk: r for r in counted.collect()}
    n, shared = len(kept), {k: [i for i, t in enumerate(r.pair_t) if r.t[t] in set(r.shared or ())] for k, r in kept.items()}
    assert n > 3 and any(shared.values()) and parts.count() == n * len(next(iter(kept.values())).parts)
    told = sum(len(r.s) + len(shared[k]) for k, r in kept.items())
    assert parts.agg(F.sum(F.size("c"))).first()[0] == places.agg(F.sum(F.size("id"))).first()[0] == told
    whole = EM.whole_sums(parts, places)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(part") == 1
    want = {}
    for r in kept.values():
        for i, c in enumerate(r.counts):
            for key in (r.s[r.pair_s[i]], (r.s[r.pair_s[i]], r.t[r.pair_t[i]])):
                want[key] = want.get(key, 0) + c
    for r in whole.collect():
        k = kept[r.chunk]
        own = np.repeat(np.arange(len(k.parts)), k.parts)
        keys = sorted([(own[i], 0, i, s) for i, s in enumerate(k.s)] + [(own[k.pair_s[i]], 1, i, (k.s[k.pair_s[i]], k.t[k.pair_t[i]])) for i in shared[r.chunk]])
        assert np.allclose(r.total, [want[key[-1]] for key in keys]) and len(r.first) == len(keys)


def test_em_cells_are_one_string_and_their_links_no_rows(spark):
    """A cell of a key that one row has goes to its chunk as one string, and is not put together of links;
    cells of keys that several rows have, or none, are. Words may hold what separates them."""
    odd = ["a\x1fb", "\x1b", "\x1bu", "\x1f", "", "\x1be\x1f", "ü"]
    rows = [(1, ["a", "b", "c"], ["x", "y"]), (2, odd, ["x", *odd[::-1]]), (3, ["a"], []), (4, None, ["x"]), (5, ["c", "a"], ["y"]),
            (6, ["a", "b"], ["x", "y"]), (6, ["a", "b"], ["x", "y"]), (6, ["c"], ["z"]), (None, ["b"], ["x"]), (None, ["c", "d"], ["x"])]
    df = spark.createDataFrame(rows, "id long, s array<string>, t array<string>")
    links = EM.banded_links(df, "id", F.col("s"), F.col("t"), 1)
    cells = EM.banded_cells(df, "id", F.col("s"), F.col("t"), 1)
    assert cells.columns == ["n", "c", "t", "size"]
    assert cells.count() == links.select(F.coalesce("key", F.lit(-1)), "j").distinct().count()
    assert cells.agg(F.sum("n")).first()[0] == links.count()
    key = lambda r: (r.c, r.t, r.size)
    assert sorted(map(key, cells.collect())) == sorted(map(key, EM._cells(links).collect()))
    once = EM.banded_cells(df.where("id < 6"), "id", F.col("s"), F.col("t"), 1).collect()
    assert all(r.t == [] and r.size == [] for r in once) and "x\x1fa\x1fb\x1fc" in {r.c for r in once}
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    own, several = plan.split("Union")[1].split("Aggregate")
    assert "_rows" in own and "collect_list" not in own and "_rows" in several
    for chunk in (2, EM.CHUNK):
        (want, log), (got, found) = (EM.train(x, rounds=3, tolerance=0, chunk=chunk) for x in (links, cells))
        assert {(r.s, r.t): round(r.p, 9) for r in got.collect()} == {(r.s, r.t): round(r.p, 9) for r in want.collect()}
        assert [round(x, 9) for _, x in found] == [round(x, 9) for _, x in log]


def test_em_packs_in_no_more_tasks_than_full_chunks_or_cores(spark):
    """Each chunk tells the others of its source words, so small links are not dealt to every shuffle partition."""
    rng = random.Random(3)
    rows = [(i, rng.choices("abcdefgh", k=20), [rng.choice("uvwxyz") + str(rng.randrange(40)) for _ in range(20)]) for i in range(50)]
    cells = EM.banded_cells(spark.createDataFrame(rows, "id long, s array<string>, t array<string>"), "id", F.col("s"), F.col("t"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert EM.chunks_of(cells).count() <= spark.sparkContext.defaultParallelism < 40
        assert EM.chunks_of(cells, 300).count() >= cells.agg(F.sum("n")).first()[0] / 300 / 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_best_targets_break_ties_by_word(spark):
    probs = spark.createDataFrame([("a", "z", 0.5), ("a", "y", 0.5), ("b", "q", 0.9), ("b", "p", 0.1)], "s string, t string, p double")
    assert sorted((r.s, r.t) for r in EM.best_targets(probs).collect()) == [("a", "y"), ("b", "q")]


def path_score(cells, pairs, choice, penalty):
    score, said = 0.0, set()
    for i, b in enumerate(choice):
        word, logit = cells[i][b]
        logit += pairs[i - 1, choice[i - 1], b] if i else 0.0
        if word in said:
            logit = logit * penalty if logit < 0 else logit / penalty
        score, said = score + logit, said | {word}
    return score


def random_sentence(rng, n):
    cells = [[(w, -rng.random()) for w in rng.sample("abcd", rng.randrange(1, 4))] for _ in range(n)]
    pairs = {(i, a, b): -rng.choice([.5, 1, 2]) for i in range(n - 1) for a in range(len(cells[i])) for b in range(len(cells[i + 1]))}
    return cells, pairs


def test_beam_of_all_widths():
    """Wide enough, the best of all outputs; of width one, the greedy choice."""
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 6)
        cells, pairs = random_sentence(rng, n)
        every = [(round(path_score(cells, pairs, c, 1.3), D.DIGITS), [cells[i][b][0] for i, b in enumerate(c)])
                 for c in itertools.product(*(range(len(x)) for x in cells))]
        words, score = D.best_beam(cells, pairs, width=10 ** 6, penalty=1.3)
        assert (round(score, D.DIGITS), words) == min(every, key=lambda e: (-e[0], e[1]))
        greedy: list[int] = []
        for i in range(n):
            greedy.append(min(range(len(cells[i])), key=lambda b: (
                -round(path_score(cells, pairs, [*greedy, b], 1.3), D.DIGITS), cells[i][b][0])))
        assert D.best_beam(cells, pairs, width=1, penalty=1.3)[0] == [cells[i][b][0] for i, b in enumerate(greedy)]
    assert D.best_beam([], {}) == ([], 0.0)


def test_beam_search_over_a_table(spark):
    lexicon = spark.createDataFrame([("a", "x", .6, 1), ("a", "y", .4, 2), ("b", "x", .5, 1), ("b", "z", .5, 2), ("c", "q", 1., 1),
                                     ("c", "never", .0001, 9)], "s string, t string, p double, rank int")
    lm = MD.BigramLM.fit(spark.createDataFrame([(["x", "z", "q"],), (["y", "x", "q"],)], "t array<string>"), "t")
    rows = [(1, ["a", "b", "c"]), (2, []), (3, None), (4, ["a"]), (5, ["new", "a", "new"]), (6, ["b"] * 300)]
    got = {r.id: (r.text, r.score) for r in D.beam_search(
        spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens", lexicon, lm).collect()}
    assert got[1][0] == "x z q" and got[2] == ("", 0.0) and got[3] == ("", 0.0) and got[4][0] == "x"
    assert got[5][0].split()[::2] == ["new", "new"] and len(got[6][0].split()) == 300
    logp = {(v, w): math.log((c + MD.ADD_K) / (n + MD.ADD_K * 5)) for v, w, c, n in (("x", "z", 1, 2), ("z", "q", 1, 1))}
    assert got[1][1] == pytest.approx(math.log(.6) + math.log(.5) + logp["x", "z"] + logp["z", "q"])


def embedded(spark, n=300, classes=3, size=4, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, size)) + np.eye(classes, size)[y] * 2
    split = np.where(np.arange(n) < n * .8, "train", np.where(np.arange(n) < n * .9, "dev", "test"))
    rows = [(str(s), v.tolist(), int(c)) for s, v, c in zip(split, x, y)]
    return spark.createDataFrame(rows + [("train", None, 1), ("train", [1.0], 1), ("train", [0.0] * size, None), (None, [0.0] * size, 1)],
                                 "split string, h array<double>, label int"), x, y, split


def test_head_descends_like_numpy(spark):
    df, x, y, split = embedded(spark)
    got = H.train(df.repartition(5), "h", "label", 3, 4, epochs=6, rate=0.5)
    x1 = np.hstack((x, np.ones((len(x), 1))))
    w, log, kept = np.zeros((3, 5)), [], []
    for _ in range(6):
        def measured(part):
            z = x1[split == part] @ w.T
            lse = np.log(np.exp(z).sum(1))
            own = y[split == part]
            return (lse - z[np.arange(len(own)), own]).mean(), (z.argmax(1) == own).mean(), np.exp(z - lse[:, None])
        train_loss, _, p = measured("train")
        p[np.arange(len(p)), y[split == "train"]] -= 1
        w = w - 0.5 * p.T @ x1[split == "train"] / len(p)
        kept.append(w)
        log.append((train_loss, *measured("dev")[:2]))
    rows = sorted(got.log.collect(), key=lambda r: r.epoch)
    assert np.allclose([(r.train_loss, r.dev_loss, r.dev_acc) for r in rows], log)
    best = got.checkpoint.first().best_epoch
    assert best == 1 + int(np.argmin([d for _, d, _ in log])) and np.allclose(got.weights, kept[best - 1])
    assert got.epochs.where(f"epoch = {best}").count() == got.weights.size
    scored = df.where("split = 'test'").withColumn("z", got.logits(F.col("h"))).collect()
    assert np.allclose([r.z for r in scored], x1[split == "test"] @ kept[best - 1].T)


def test_head_stops_early(spark):
    """A rate that overshoots: the log ends where patience ran out, the best epoch's weights are kept."""
    df, *_ = embedded(spark, n=60, seed=3)
    got = H.train(df, "h", "label", 3, 4, epochs=30, rate=60.0, patience=2)
    rows = sorted(got.log.collect(), key=lambda r: r.epoch)
    report = W.best_checkpoint(got.log, patience=2).first()
    assert len(rows) < 30 and report.stop_epoch == len(rows) == got.checkpoint.first().epochs_run
    assert report.best_value == min(r.dev_loss for r in rows)


def test_head_without_rows(spark):
    none = spark.createDataFrame([], "split string, h array<double>, label int")
    got = H.train(none, "h", "label", 2, 3, epochs=2)
    assert not got.weights.any() and [r.dev_loss for r in got.log.collect()] == [None, None]
    assert K.PATIENCE == 3

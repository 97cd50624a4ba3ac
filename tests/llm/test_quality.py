import zlib

import numpy as np
import pytest

from quire.llm import quality as q


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return q.train(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = q.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([p == y for p, y in test]) >= 0.98
    known = [y for d, y in label.items() if not held(d)]
    assert abs(model.prior - np.mean(known)) < 0.03
    assert np.mean([p for p, y in test if y == 1]) >= 0.98


def test_held_out_rows_teach_nothing(tables, model):
    docs, labels = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    blank = docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("x")).otherwise(F.col("text")))
    other = q.train(blank.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), flipped)
    assert np.allclose(other.weight, model.weight, atol=1e-6) and other.prior == model.prior


def brute_risk(positive, unlabelled, prior, w, b):
    """The two parts of the risk as sums over the texts, for features scaled as the fit scales them."""
    loss = lambda z, y: np.log1p(np.exp(-y * z))
    of = lambda xs, y: sum(loss(float(x @ w) + b, y) for x in xs) / len(xs)
    return prior * of(positive, 1), of(unlabelled, -1) - prior * of(positive, -1)


@pytest.mark.parametrize("prior", [0.15, 0.3])
def test_risk_matches_brute_force(prior):
    """Where the bracket stays above zero, the fit ends where the brute-force risk plus ridge is lower than around it, and one step from zero goes down its numeric slope."""
    r = np.random.default_rng(5)
    dims = q.N_FEATURES
    positive, unlabelled = (np.zeros((n, dims), np.float32) for n in (60, 90))
    positive[:, :3], unlabelled[:, :3] = r.normal(0.7, 1, (60, 3)), r.normal(0.1, 1, (90, 3))
    every = np.concatenate([positive, unlabelled])
    scaled = [(x - every.mean(axis=0)) / (every.std(axis=0) + 1e-3) for x in (positive, unlabelled)]

    def objective(w, b, decay=2e-3):
        first, bracket = brute_risk(*scaled, prior, w, b)
        return first + max(0.0, bracket) + decay / 2 * float(w @ w)

    start = float(np.log(prior / (1 - prior)))
    one = q.fit(positive, unlabelled, prior, steps=1, rate=1e-3)
    slope = [(objective(np.eye(dims)[k] * 1e-5, start) - objective(-np.eye(dims)[k] * 1e-5, start)) / 2e-5 for k in range(3)]
    assert (np.sign(one.weight[:3]) == -np.sign(slope)).all()
    m = q.fit(positive, unlabelled, prior, steps=3000, rate=0.01)
    least = objective(m.weight, m.bias)
    assert least <= objective(np.zeros(dims), start) and brute_risk(*scaled, prior, m.weight, m.bias)[1] > 0
    for k in range(3):
        for h in (-0.05, 0.05):
            assert objective(m.weight + np.eye(dims)[k] * h, m.bias) >= least - 1e-4
    assert all(objective(m.weight, m.bias + h) >= least - 1e-4 for h in (-0.05, 0.05))


def test_negative_bracket_is_undone():
    """Many features and few texts: the plain unbiased risk would push the bracket far below zero; the fit keeps it about there."""
    r = np.random.default_rng(2)
    positive, unlabelled = r.normal(0, 1, (30, q.N_FEATURES)).astype(np.float32), r.normal(0, 1, (30, q.N_FEATURES)).astype(np.float32)
    every = np.concatenate([positive, unlabelled])
    scaled = [(x - every.mean(axis=0)) / (every.std(axis=0) + 1e-3) for x in (positive, unlabelled)]
    m = q.fit(positive, unlabelled, 0.5, steps=400)
    assert brute_risk(*scaled, 0.5, m.weight, m.bias)[1] > -0.1


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_is_estimated(share):
    r = np.random.default_rng(1)

    def draw(n, good):
        x = np.zeros((n, q.N_FEATURES), np.float32)
        x[:, :5] = r.normal(1.2 if good else -1.2, 1, (n, 5))
        return x

    n = 2000
    mixed = np.concatenate([draw(int(n * share), True), draw(n - int(n * share), False)])
    assert abs(q.estimate_prior(draw(1500, True), mixed) - share) < 0.05
    # The positives of the mixture themselves: a row's half is the same in both sets.
    good, side = np.arange(n) < int(n * share), r.random(n) < 0.5
    assert abs(q.estimate_prior(mixed[good], mixed, (side[good], side)) - share) < 0.05


def test_repeated_ids_train_alike(spark):
    rows = [(k, f"text {k} of some words " * (k % 7 + 1)) for k in range(40)] + [(3, "another text"), (3, "zzz"), (5, None)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    one, two = (q.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 2), (rows[::-1], 5)))
    assert np.array_equal(one.weight, two.weight) and one.prior == two.prior


def test_risk_is_non_negative_and_separates():
    r = np.random.default_rng(0)
    good, bad = r.normal(1, 1, (400, q.N_FEATURES)), r.normal(-1, 1, (400, q.N_FEATURES))
    m = q.fit(good[:200], np.concatenate([good[200:], bad[:200]]), 0.5)
    assert (m.scores(good[200:]) > 0.5).mean() > 0.95 and (m.scores(bad[200:]) < 0.5).mean() > 0.95


def test_odd_rows(odd, empty, spark, model):
    rows = q.score(odd, model).collect()
    assert len(rows) == odd.count()
    scores = {}
    for r in rows:
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert scores[1] == scores[2] and len(scores[5]) == 1 and scores[4] == scores[5]
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert q.score(empty, model).count() == 0
    assert q.accept(odd, model).columns == odd.columns and q.accept(empty, model).count() == 0
    none = q.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["predicted"] for r in q.score(odd, none).collect()} == {1}
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (None, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.score(odd, q.train(odd, labels)).count() == odd.count()

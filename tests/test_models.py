"""Classifier interface: probabilities, out-of-fold scores, strategies, learning curves, nested validation; ranks range by range."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.operators import colstats, ml, validation


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        c = i % 3
        rows.append((i, f"c{c}", (rng.normal(size=4) + 2.5 * np.eye(4)[c]).tolist()))
    return spark.createDataFrame(rows, "sample_id long, grp string, values array<double>").persist()


@pytest.mark.parametrize("model", ["rf", "svm", "elasticnet"])
def test_probabilities_sum_to_one_and_agree_with_predictions(study, model):
    m = ml.Classifier(model, **({"numTrees": 10} if model == "rf" else {})).fit(study)
    p = m.predict_proba(study).join(m.predict(study).select("sample_id", "predicted"), "sample_id").collect()
    for r in p:
        shares = {c: r[c] for c in ("c0", "c1", "c2")}
        assert np.isclose(sum(shares.values()), 1) and max(shares, key=shares.get) == r["predicted"]


def test_out_of_fold_covers_each_sample_once(study):
    got = ml.Classifier("elasticnet").out_of_fold(study, 3)
    rows = got.collect()
    assert sorted(r["sample_id"] for r in rows) == list(range(90))
    auc = {r["class"]: r["auc"] for r in validation.one_vs_rest_auc(got, "label", ["c0", "c1", "c2"]).collect()}
    for c in ("c0", "c1", "c2"):
        s, y = np.array([r[c] for r in rows]), np.array([r["label"] == c for r in rows])
        assert np.isclose(auc[c], np.mean([(a > b) + 0.5 * (a == b) for a in s[y] for b in s[~y]]))
    assert auc["micro"] > 0.9


def test_strategies_curve_and_nested_validation(study):
    m = ml.Classifier("elasticnet")
    got = {r["strategy"]: r for r in m.compare_strategies(study, ["kfold", "stratified_kfold"], 2).collect()}
    assert set(got) == {"kfold", "stratified_kfold"} and all(r["min"] <= r["mean"] <= r["max"] for r in got.values())
    curve = m.learning_curve(study, [0.5, 1.0]).orderBy("share").collect()
    assert [r["samples"] for r in curve] == [36, 72] and curve[1]["test"] > 0.6
    nested = m.nested_cv(study, [{"regParam": 0.01}, {"regParam": 50.0, "elasticNetParam": 1.0}], 2, 2).collect()
    assert [json.loads(r["options"]) for r in nested] == [{"regParam": 0.01}] * 2


def test_ranks_and_numbers_range_by_range(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 40, 500).astype(float), np.zeros(30), np.array([1.0])):
        df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "k int, v double").repartition(3)
        got = {(r["k"], r["v"]): r["rank"] for r in colstats.average_ranks(df, ["k"], "v").collect()}
        for k in (0, 1):
            x = values[k::2]
            assert all(np.isclose(got[k, v], (x < v).sum() + ((x == v).sum() + 1) / 2) for v in set(x.tolist()))
    ids = spark.range(101).withColumnRenamed("id", "key").repartition(5)
    folds = validation.folds(ids, "key", "kfold", 4).where("role = 'test'").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [25, 25, 25, 26]
    series = validation.folds(ids, "key", "time_series", 4).groupBy("fold", "role").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()
    at = {(r["fold"], r["role"]): (r["a"], r["b"]) for r in series}
    assert all(at[f, "train"] == (0, at[f, "test"][0] - 1) and at[f, "test"][1] - at[f, "test"][0] == 19 for f in range(4)) and at[3, "test"][1] == 100
    assert colstats.average_ranks(ids.limit(0), [], "key").count() == 0


def test_bootstrap_interval_surrounds_the_accuracy(spark):
    rng = np.random.default_rng(5)
    hit = rng.random(2000) < 0.8
    df = spark.createDataFrame([(i, "a", "a" if h else "b") for i, h in enumerate(hit.tolist())], "key long, actual string, predicted string").repartition(3)
    r = validation.bootstrap_interval(df, "key", "actual", "predicted", 100).first()
    assert r["low"] < hit.mean() < r["high"] and abs(r["mean"] - hit.mean()) < 0.01
    # Out-of-bag parts hold exp(-1) of the rows: the spread of their accuracies is that of so many draws without replacement.
    want = np.sqrt(0.8 * 0.2 / 2000 * (np.e - 1))
    assert 0.7 * want < (r["high"] - r["low"]) / (2 * 1.96) < 1.4 * want


def test_autoencoder_learns_a_plane(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(256, 2)) @ rng.normal(size=(2, 8))
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "sample_id long, grp int, values array<double>")
    early, late = (ml.Autoencoder((16,), 2, epochs=e, rate=5e-3).fit(df).encode(df) for e in (1, 40))
    error = lambda d: d.agg(F.avg("error")).first()[0]
    assert error(late) < 0.3 * error(early) and len(late.first()["values"]) == 2


def test_independent_components_are_found(spark):
    from lumaspec.operators import latent

    rng = np.random.default_rng(7)
    s = np.stack([rng.uniform(-1, 1, 1500), np.sign(rng.normal(size=1500)) * rng.exponential(size=1500)], axis=1)
    x = s @ np.array([[1.0, 0.4], [0.3, 1.0]])
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "sample_id long, grp int, values array<double>")
    got = np.array([[r["IC1"], r["IC2"]] for r in latent.ica(df, 2).orderBy("sample_id").collect()])
    c = np.abs(np.corrcoef(np.hstack([got, s]).T)[:2, 2:])
    assert sorted(c.max(axis=1))[0] > 0.97 and sorted(c.min(axis=1))[-1] < 0.2

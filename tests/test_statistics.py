"""Distribution functions, golden cases and statistical validity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.functions import dist
from lumaspec.operators import colstats, hypotheses, latent, normalise, validation
from lumaspec.plans.matrix import nearest_feature, numeric_columns, to_arrays, to_long


def arrays(spark, x, groups=None):
    rows = [(i, groups[i] if groups is not None else "g", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, grp string, values array<double>")


def table(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["sample_id"], {})[r["j"]] = r["value"]
    return np.array([[out[i][j] if out[i][j] is not None else np.nan for j in sorted(out[i])] for i in sorted(out)])


@pytest.mark.parametrize("t, df, p", [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e7, 0.05), (3.169273, 10, 0.01)])
def test_t(t, df, p):
    assert dist.t_two_sided(t, df) == pytest.approx(p, abs=1e-6)


def test_other_tails():
    assert dist.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert dist.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_quantile(0.95, 2, 10) == pytest.approx(4.102821, abs=1e-4)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)


@pytest.mark.parametrize("q, k, df", [(3.877, 3, 10), (4.327, 4, 10), (3.578, 3, 20), (2.829, 2, 60)])
def test_studentised_range(q, k, df):
    assert dist.studentised_range_tail(q, k, df) == pytest.approx(0.05, abs=5e-4)


def test_pqn_golden(spark):
    got = table(normalise.pqn(to_long(arrays(spark, [[1, 2], [2, 4], [4, 8]]))))
    assert np.allclose(got, [[2, 4]] * 3)


def test_scaling_of_two_rows_and_constants(spark):
    got = table(normalise.scale(to_long(arrays(spark, [[1, 5], [3, 5]])), "uv"))
    assert np.allclose(got, [[-1, 0], [1, 0]])
    assert np.isnan(table(normalise.scale(to_long(arrays(spark, [[1, 5], [3, 5]])), "minmax"))[:, 1]).all()
    with pytest.raises(ValueError):
        normalise.scale(to_long(arrays(spark, [[1.0]])), "what")


def test_merged_moments(spark):
    x = np.random.default_rng(0).normal(size=(30, 3))
    state = lambda m: to_long(m).groupBy("j").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"))
    got = {r["j"]: r for r in normalise.merge_moments(state(arrays(spark, x[:12])), state(arrays(spark, x[12:]))).collect()}
    assert np.allclose([got[j]["mean"] for j in range(3)], x.mean(0))
    assert np.allclose([got[j]["m2"] / got[j]["n"] for j in range(3)], x.var(0))


def test_knn_takes_the_two_nearest(spark):
    got = table(normalise.knn_impute(to_long(arrays(spark, [[0, 0, 1], [0, 0, 3], [9, 9, 90]])).withColumn("value", F.when((F.col("sample_id") != 0) | (F.col("j") != 2), F.col("value")))))
    assert got[0, 2] == pytest.approx((3 + 90) / 2)


def test_constant_anchor_and_two_samples(spark):
    got = {r["j"]: r for r in hypotheses.stocsy(arrays(spark, [[1, 2, 5], [2, 4, 5]]), 0).collect()}
    assert got[1]["r"] == pytest.approx(1) and got[1]["p_value"] == 1 and got[2]["r"] is None
    assert all(r["r"] is None for r in hypotheses.stocsy(arrays(spark, [[1, 2, 5], [2, 4, 5], [2, 3, 5]]), 2).collect())


def test_stocsy_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(20, 6))
    x[:, 3] = 2 * x[:, 1] + 0.1 * x[:, 3]
    got = {r["j"]: r for r in hypotheses.stocsy(arrays(spark, x), 1).collect()}
    for j in range(6):
        r = np.corrcoef(x[:, 1], x[:, j])[0, 1]
        assert got[j]["r"] == pytest.approx(r, abs=1e-12)
        if j != 1:
            assert got[j]["p_value"] == pytest.approx(float(dist.t_two_sided(r * np.sqrt(18 / (1 - r * r)), 18)), rel=1e-9)


def test_corrections_pass_nulls(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "feature string, p_value double")
    got = {r["feature"]: r["p_adj"] for r in hypotheses.adjust(df, "fdr_bh").collect()}
    assert got["d"] is None and got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.04)
    assert {r["feature"]: r["p_adj"] for r in hypotheses.adjust(df, "holm").collect()}["c"] == pytest.approx(0.06)
    with pytest.raises(ValueError):
        hypotheses.adjust(df, "other")


def test_exact_mann_whitney(spark):
    rows = [("x", "a", float(v)) for v in (1, 2, 3)] + [("x", "b", float(v)) for v in (4, 5, 6)]
    r = hypotheses.mann_whitney(spark.createDataFrame(rows, "feature string, grp string, value double"), "a", "b").first()
    assert r["u"] == 0 and r["p_value"] == pytest.approx(0.1)


def test_lone_group_gives_null(spark):
    rows = [("x", "a", 1.0), ("x", "b", 2.0), ("x", "b", 3.0)]
    r = hypotheses.welch(hypotheses.two_groups(spark.createDataFrame(rows, "feature string, grp string, value double"), "a", "b")).first()
    assert r["t"] is None and r["df"] is None


def test_layouts(spark):
    m = arrays(spark, [[1, 2, 3], [4, 5, 6]])
    assert [r["values"] for r in to_arrays(to_long(m)).orderBy("sample_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    df = spark.createDataFrame([("a", 1, 2.0)], "g string, n int, v double")
    assert numeric_columns(df, ["g"]) == ["n", "v"]
    with pytest.raises(ValueError):
        numeric_columns(df, [], ["g"])
    axis = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "j long, coord double")
    assert nearest_feature(axis, spark.createDataFrame([(1.5,), (9.0,)], "target double")).orderBy("target").select("j").collect() == [(0,), (2,)]


def test_pca_both_ways(spark):
    x = np.random.default_rng(1).normal(size=(12, 7)) * np.arange(1, 8)
    m = arrays(spark, x)
    model = latent.pca(m, 2, "mean")
    s = np.array([[r["PC1"], r["PC2"]] for r in model.scores(m).orderBy("sample_id").collect()])
    u, d, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(s), np.abs(u[:, :2] * d[:2]))
    _, t, ratio = latent.pca_dual(to_long(m), 2)
    assert np.allclose(np.abs(t), np.abs(s)) and np.allclose(ratio, model.ratios)
    with pytest.raises(ValueError):
        latent.pca(arrays(spark, [[1, float("nan")]]))


def test_pls_and_vip(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    y = 3 * x[:, 0] - x[:, 1]
    m = arrays(spark, x).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sample_id long, y double"), "sample_id")
    model = latent.pls(m, F.col("y"), 5)
    assert model.r2 == pytest.approx(1, abs=1e-8)
    assert (model.vip**2).sum() == pytest.approx(5)
    got = np.array([r["predicted"] for r in model.predict(m).orderBy("sample_id").collect()])
    assert np.allclose(got, y)
    assert not latent.vip(np.ones((3, 1)), np.zeros(1), np.ones(1)).any()


def test_opls_parts_classes_but_not_noise(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 20))
    groups = ["A"] * 30 + ["B"] * 30
    none = latent.opls_da(arrays(spark, x, groups)).first()
    x[30:, :6] += 3
    some = latent.opls_da(arrays(spark, x, groups)).first()
    assert some["q2"] > 0.3 and some["r2y"] > 0.7 and none["q2"] <= 0.2
    p = latent.permutation_test(arrays(spark, x, groups), 20).first()
    assert p["p_value"] == pytest.approx(1 / 21) and p["score"] > p["mean_permuted"]


def test_ward_clusters(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=(5, 3)) + c for c in (0, 20, 60)])
    _, rows, flat = latent.hca(to_long(arrays(spark, x)), 3)
    assert [len(set(flat[i : i + 5])) for i in (0, 5, 10)] == [1, 1, 1] and len(set(flat)) == 3
    assert all(a[2] <= b[2] + 1e-9 for a, b in zip(rows, rows[1:], strict=False)) and rows[-1][3] == 15


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, y int")
    split = validation.stratified_split(df, "id", "y")
    assert {(r["y"], r["n"]) for r in split.where("role = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 4), (1, 4), (2, 4)}
    for s in ("kfold", "stratified_kfold", "loo", "repeated_kfold", "group_kfold"):
        f = validation.folds(df, "id", s, 3, label="y", group="y", repeats=2)
        tested = f.where("role = 'test'").groupBy("repeat", "id").agg(F.count("*").alias("n")).select("n").distinct().collect()
        assert tested == [(1,)]
    series = validation.folds(df, "id", "time_series", 3).groupBy("fold", "role").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
    at = {(r["fold"], r["role"]): (r["a"], r["b"]) for r in series}
    assert all(at[f, "train"][1] < at[f, "test"][0] for f in range(3))
    with pytest.raises(ValueError):
        validation.folds(df, "id", "other")


def test_mean_correlation_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(9, 12))
    c = np.corrcoef(x)
    got = {r["sample_id"]: r["r"] for r in colstats.mean_sample_correlation(arrays(spark, x)).collect()}
    assert all(got[i] == pytest.approx((c[i].sum() - 1) / 8) for i in range(9))

"""Models in the space of samples against plain linear algebra, and against the form that uses the features' cross products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.operators import latent, linalg, reports, wide


def matrix(spark, x, classes):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, classes, strict=True))], "sample_id long, grp int, values array<double>")


@pytest.fixture(scope="module")
def study():
    rng = np.random.default_rng(0)
    classes = np.repeat([0, 1], [9, 8])
    x = rng.normal(size=(17, 40)) @ np.diag(np.linspace(0.5, 3, 40))
    x[:, :6] += classes[:, None] * 2
    x[:, 39] = 1.0  # a constant feature
    return x, classes


def scaled(x, power):
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1) ** power


def test_cross_products_in_blocks(spark, study, monkeypatch):
    x, classes = study
    df = matrix(spark, x, classes).repartition(3)
    n, mean, c = linalg.moments(df, rows=7)
    z = x - x.mean(0)
    assert n == 17 and np.allclose(mean, x.mean(0)) and np.allclose(c, z.T @ z)
    ids, k = linalg.gram(wide.scaled(df, "uv"), block=9)
    assert ids == list(range(17)) and np.allclose(k, scaled(x, 1) @ scaled(x, 1).T)
    monkeypatch.setattr(linalg, "BLOCK_NUMBERS", 0)
    assert np.allclose(linalg.gram_of(df, ids, 1.0)[0], k)
    fold = np.arange(17) % 3
    for f, g in enumerate(linalg.gram_of(df, ids, 0.5, fold, 3)):
        t = x[fold != f]
        sd = t.std(0)
        w = (x - t.mean(0)) / np.where(sd > 0, sd, 1) ** 0.5
        assert np.allclose(g, w @ w.T)
    sizes, means, within = linalg.class_moments(df, [0, 1], rows_of=7)
    left = np.concatenate([x[classes == c] - x[classes == c].mean(0) for c in (0, 1)])
    assert sizes.tolist() == [9, 8] and np.allclose(means[1], x[classes == 1].mean(0)) and np.allclose(within, left.T @ left)
    with pytest.raises(ValueError):
        linalg.sample_ids(df.unionByName(df))


def test_wide_pca_equals_the_feature_form(spark, study):
    x, classes = study
    df = matrix(spark, x, classes)
    a, b = latent.pca(df, 3), wide.pca(df, 3)
    left = np.array([[r["PC1"], r["PC2"], r["PC3"]] for r in a.scores(df).orderBy("sample_id").collect()])
    right = np.array([[r["PC1"], r["PC2"], r["PC3"]] for r in b.scores.orderBy("sample_id").collect()])
    assert np.allclose(left, right)
    assert np.allclose(a.loadings, [[r["PC1"], r["PC2"], r["PC3"]] for r in b.loadings.orderBy("j").collect()])
    assert np.allclose(a.ratios, [e[1] for e in b.explained])
    t2 = {r["sample_id"]: (r["t2"], r["inside"]) for r in a.hotelling(df).collect()}
    for r in b.t2.collect():
        assert np.isclose(t2[r["sample_id"]][0], r["t2"]) and t2[r["sample_id"]][1] == r["inside"]


@pytest.mark.parametrize("scaling", ["uv", "pareto", "mean"])
def test_wide_pls_equals_the_feature_form(spark, study, scaling):
    x, classes = study
    df = matrix(spark, x, classes)
    a, b = latent.pls(df, F.col("grp"), 3, scaling), wide.pls(df, F.col("grp"), 3, scaling)
    assert np.isclose(a.r2, b.r2y)
    assert np.allclose(a.vip, [r["vip"] for r in b.features.orderBy("j").collect()])
    want = {r["sample_id"]: r["predicted"] for r in a.predict(df).collect()}
    assert all(np.isclose(want[r["sample_id"]], r["predicted"]) for r in b.fitted.collect())
    coef = np.array([r["coef"] for r in b.features.orderBy("j").collect()])
    power = wide.POWERS[scaling]
    assert np.allclose(scaled(x, power) @ coef + classes.mean(), [want[i] for i in range(17)])


def test_wide_opls_equals_arrays(spark, study):
    x, classes = study
    df = matrix(spark, x, classes)
    z, y = scaled(x, 0.5), classes - classes.mean()
    m = latent.opls_arrays(z, y, 2)
    got = wide.opls(df, F.col("grp"), 2)
    rows = got.scores.orderBy("sample_id").collect()
    assert np.allclose([r["t_pred"] for r in rows], m["t"])
    f = got.features.orderBy("j").collect()
    assert np.allclose([r["w"] for r in f], m["w"]) and np.allclose([r["po2"] for r in f], m["po"][1])
    t = m["t"]
    p = z.T @ t / (t @ t)
    rec = np.outer(t, p) + sum(np.outer(np.array([r[f"t_ortho{i + 1}"] for r in rows]), m["po"][i]) for i in range(2))
    assert np.isclose(got.r2x, 1 - ((z - rec) ** 2).sum() / (z**2).sum())
    assert np.isclose(got.r2y, 1 - ((y - t * m["c"][-1]) ** 2).sum() / (y**2).sum())
    left = {(r["sample_id"], r["j"]): r["value"] for r in wide.corrected(df, F.col("grp"), 2).collect()}
    assert all(np.isclose(left[i, j], m["corrected"][i, j]) for i in range(17) for j in range(40))


def test_cross_validation_equals_the_array_form(spark, study):
    x, classes = study
    df = matrix(spark, x, classes)
    fold = np.concatenate([np.arange(9) // 3, np.arange(8) // 3])
    press, wrong, ss = {}, {}, sum(((classes[fold == f] - classes.mean()) ** 2).sum() for f in range(3))
    for f in range(3):
        a, b = fold != f, fold == f
        sd = x[a].std(0)
        z = (x - x[a].mean(0)) / np.where(sd > 0, sd, 1) ** 0.5
        y = classes - classes[a].mean()
        m = latent.opls_arrays(z[a], y[a], a.sum() - 1)
        for c in range(1, len(m["c"]) + 1):
            got = latent.opls_predict(m, z[b], c)
            press.setdefault(c, []).append(((y[b] - got) ** 2).sum())
            wrong.setdefault(c, []).append(int(((got > 0) != (y[b] > 0)).sum()))
    cv = wide.opls_cv(df, 3).set_index("components")
    for c in range(1, 6):
        assert np.isclose(cv.loc[c, "q2"], 1 - sum(press[c]) / ss) and cv.loc[c, "misclassified"] == sum(wrong[c])
    old = latent.opls_da(df, 3).first()
    whole = wide.opls_da(df, None, 3)
    row = whole.summary.first()
    assert np.isclose(row["r2y"], old["r2y"]) and row["components"] == old["components"]
    assert whole.important(1.0).where("vip < 1").count() == 0 and whole.features.count() == 40
    assert {r["direction"] for r in whole.features.collect()} <= {"High in 0", "High in 1", "Under cut off"}


def test_pairs_of_classes(spark, study):
    x, _ = study
    summaries, features = wide.lazy_opls_da(matrix(spark, x, np.arange(17) % 3), 1, 2)
    assert sorted((r["group1"], r["group2"]) for r in summaries.collect()) == [("0", "1"), ("0", "2"), ("1", "2")]
    assert features.count() == 3 * 40
    with pytest.raises(ValueError):
        wide.lazy_opls_da(matrix(spark, x, np.zeros(17, dtype=int)))


def test_leave_one_out(spark, study):
    x, classes = study
    got = wide.pls_quality(matrix(spark, x, classes), F.col("grp"), 2).iloc[0]
    z, y = scaled(x, 1.0), classes.astype(float)

    def fit(a, b):
        xm, ym = z[a].mean(0), y[a].mean()
        k = latent.pls_kernel((z[a] - xm).T @ (z[a] - xm), (z[a] - xm).T @ (y[a] - ym), float(((y[a] - ym) ** 2).sum()), 2)
        return (z[b] - xm) @ k["coef"][:, -1] + ym

    every = np.arange(17)
    ss = ((y - y.mean()) ** 2).sum()
    loo = np.array([fit(np.delete(every, i), [i])[0] for i in every])
    assert np.isclose(got["q2"], 1 - ((y - loo) ** 2).sum() / ss)
    assert np.isclose(got["rmse"], np.sqrt(((y - fit(every, every)) ** 2).mean()))


def test_shift_lists_of_odd_text(spark):
    texts = ["8.870-8.930", "1.323", "1.2,3", "-0.5", "a-b", "1-2-3", "", None, " 2.5 ", "3-", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reports.shift_centre(F.col("t"))).collect()]
    assert got == [pytest.approx(8.9), 1.323, 1.2, -0.5, None, None, None, None, 2.5, None, None]


def test_box_whiskers_and_pairs(spark):
    df = spark.createDataFrame([("a", float(v), i) for i, v in enumerate([1, 2, 3, 4, 100])] + [("b/c", None, 9), ("b/c", 5.0, 7)], "grp string, v double, o int")
    got = {r["grp"]: r for r in reports.box_whiskers(df, "grp", "v").collect()}
    assert (got["a"]["low"], got["a"]["high"], got["a"]["outliers"]) == (1.0, 4.0, 1) and got["b/c"]["n"] == 1
    assert [tuple(r) for r in reports.named_pairs(df, "grp", "o").collect()] == [("a", "b/c", "a_vs_b_c")]


def test_loadings_of_folds(spark, study):
    x, classes = study
    got = wide.cv_loadings(matrix(spark, x, classes), 1, 3)
    rows = {(r["fold"], r["j"]): r["value"] for r in got.collect()}
    fold = np.concatenate([np.arange(9) // 3, np.arange(8) // 3])
    for f in range(3):
        z, y = scaled(x[fold != f], 0.5), classes[fold != f] - classes[fold != f].mean()
        t = latent.opls_arrays(z, y, 1)["t"]
        assert np.allclose([rows[f, j] for j in range(40)], z.T @ t / (t @ t))
    table = latent.jackknife(got, 3).collect()
    assert [r["mean"] for r in table] == sorted(r["mean"] for r in table) and len(table) == 40


def test_offset_and_coefficients(spark, study):
    x, classes = study
    df = matrix(spark, x, classes)
    model = latent.pls(df, F.col("grp"), 2, "pareto")
    b = np.array([r["coef"] for r in model.coefficients(spark).orderBy("j").collect()])
    assert all(np.isclose(x[r["sample_id"]] @ b + model.offset, r["predicted"]) for r in model.predict(df).collect())


def test_discriminants_part_the_classes(spark, study):
    x, classes = study
    scores, shares = latent.lda(matrix(spark, x[:, :5], classes))
    t = {r["sample_id"]: r["LD1"] for r in scores.collect()}
    z = x[:, :5]
    within = sum((z[classes == c] - z[classes == c].mean(0)).T @ (z[classes == c] - z[classes == c].mean(0)) for c in (0, 1)) / 15
    w = np.linalg.solve(within, z[classes == 1].mean(0) - z[classes == 0].mean(0))
    got = np.array([t[i] for i in range(17)])
    assert np.isclose(abs(np.corrcoef(got, z @ w)[0, 1]), 1) and np.isclose(sum(shares), 1)

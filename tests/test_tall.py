"""Models of more samples than ``LIMIT``: queries against arrays, the feature form against the sample form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.catalogue import QUERIES
from lumaspec.operators import latent, linalg, tall, wide


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Three classes of samples whose ids are out of order, more than the limit set below."""
    rng = np.random.default_rng(8)
    label = np.arange(90) % 3
    x = rng.normal(size=(90, 6)) @ np.diag(np.linspace(0.5, 2, 6))
    x[:, :2] += 0.8 * label[:, None]
    x[:, 5] = 0.1  # a constant that no double holds
    folder = tmp_path_factory.mktemp("tall")
    spark.createDataFrame([(int(i), [float(v) for v in x[i]], int(label[i])) for i in rng.permutation(90)], "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(str(folder / "embeddings.parquet"))
    return str(folder), x, label


@pytest.fixture(autouse=True)
def few(monkeypatch):
    """Tables of these tests have too many samples for the sample form."""
    for module in (linalg, wide, tall):
        monkeypatch.setattr(module, "LIMIT", 20)


def two(table):
    _, x, label = table
    ids = np.flatnonzero(label < 2)
    z = x[ids] - x[ids].mean(0)
    z[:, 5] = 0
    return ids, z, label[ids] - label[ids].mean()


def test_f1_pls_quality(spark, table):
    _, z, y = two(table)

    def fit(a, b):
        xm, ym = z[a].mean(0), y[a].mean()
        k = latent.pls_kernel((z[a] - xm).T @ (z[a] - xm), (z[a] - xm).T @ (y[a] - ym), float(((y[a] - ym) ** 2).sum()), 2)
        return (z[b] - xm) @ k["coef"][:, -1] + ym

    every = np.arange(len(y))
    row = QUERIES["pls_quality"](spark, table[0]).first()
    left = y - fit(every, every)
    assert row["r2"] == pytest.approx(1 - (left**2).sum() / (y**2).sum(), abs=2e-6) and row["rmse"] == pytest.approx(np.sqrt((left**2).mean()), abs=2e-6)
    from lumaspec.queries.latent import two as rows

    q2 = wide.pls_quality(rows(spark, table[0]), F.col("grp"), 2, "mean")["q2"][0]
    loo = np.array([fit(np.delete(every, i), [i])[0] for i in every])
    assert q2 == pytest.approx(1 - ((y - loo) ** 2).sum() / (y**2).sum())


def test_f4_pairs_of_classes(spark, table):
    at, x, label = table
    got = {(r["group1"], r["group2"], r["j"]): r for r in QUERIES["lazy_opls_da"](spark, at).collect()}
    assert len(got) == 3 * 6
    for a, b in ((0, 1), (0, 2), (1, 2)):
        ids = np.flatnonzero((label == a) | (label == b))
        z = (x[ids] - x[ids].mean(0))[:, :5]
        t = latent.opls_arrays(z, (label[ids] == b) - (label[ids] == b).mean(), 1)["t"]
        p = z.T @ t / (t @ t)
        for j in range(5):
            r = got[str(a), str(b), j]
            assert (r["cov"], r["corr"]) == pytest.approx((p[j], p[j] * np.sqrt(t @ t) / np.linalg.norm(z[:, j])), abs=2e-6)
        assert (got[str(a), str(b), 5]["cov"], got[str(a), str(b), 5]["corr"]) == (0, None)


def test_f5_corrected_features(spark, table):
    ids, z, y = two(table)
    want = latent.opls_arrays(z, y, 1)["corrected"]
    got = {(r["sample_id"], r["j"]): r["value"] for r in QUERIES["opls_corrected"](spark, table[0]).collect()}
    assert len(got) == want.size
    assert all(got[i, j] == pytest.approx(want[k, j], abs=2e-6) for k, i in enumerate(ids) for j in range(6))


def validated(table, kfold):
    """(misclassified, components, q2) of each number of components, over contiguous folds, Pareto scaling."""
    _, x, label = table
    x, y = x[label < 2, :5], label[label < 2].astype(float)
    fold, press, wrong = np.zeros(len(y), dtype=int), {}, {}
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        fold[at] = np.arange(len(at)) // -(-len(at) // kfold)
    for f in range(kfold):
        a, b = fold != f, fold == f
        scale = np.sqrt(x[a].std(0))
        m = latent.opls_arrays((x[a] - x[a].mean(0)) / scale, y[a] - y[a].mean(), 5)
        for c in range(1, len(m["c"]) + 1):
            got = latent.opls_predict(m, (x[b] - x[a].mean(0)) / scale, c)
            press[c] = press.get(c, 0) + ((y[b] - y[a].mean() - got) ** 2).sum()
            wrong[c] = wrong.get(c, 0) + int(((got > 0) != (y[b] > y[a].mean())).sum())
    return sorted((wrong[c], c, 1 - press[c] / ((y - y.mean()) ** 2).sum()) for c in press)


def shares(table, components):
    _, x, label = table
    x, y = x[label < 2, :5], label[label < 2] - label[label < 2].mean()
    z = (x - x.mean(0)) / np.sqrt(x.std(0))
    m = latent.opls_arrays(z, y, components)
    t = m["t"]
    left = m["corrected"] - np.outer(t, m["corrected"].T @ t / (t @ t))
    return 1 - (left**2).sum() / (z**2).sum(), 1 - ((y - t * m["c"][-1]) ** 2).sum() / (y**2).sum()


def test_f6_summary(spark, table):
    r = QUERIES["opls_da_summary"](spark, table[0]).first()
    wrong, components, q2 = next(v for v in validated(table, 3) if v[1] == 2)
    assert (r["components"], r["misclassified"], r["n"]) == (components, wrong, 60)
    assert (r["q2"], r["r2x"], r["r2y"]) == pytest.approx((q2, *shares(table, 2)))


def test_f7_components_by_cross_validation(spark, table):
    r = QUERIES["opls_da"](spark, table[0]).first()
    wrong, components, q2 = validated(table, 3)[0]
    assert (r["components"], r["misclassified"], r["n"]) == (components, wrong, 60)
    assert (r["q2"], r["r2y"]) == pytest.approx((q2, shares(table, components)[1]))


def test_f7_late_components_are_exact(spark):
    """A model of all components is least squares, however close to it the first ones come; so are its counts of misclassified."""
    rng = np.random.default_rng(5)
    y = np.arange(3000) % 2
    x = rng.normal(size=(3000, 12)) + 0.1 * y[:, None] * np.linspace(-1, 1, 12)
    cv = wide.opls_cv(spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(3000)], "sample_id long, grp int, values array<double>"), 3)
    fold, press, wrong = np.arange(3000) // 1000, 0, 0
    for f in range(3):
        a, b = fold != f, fold == f
        xm, ym = x[a].mean(0), y[a].mean()
        got = (x[b] - xm) @ np.linalg.lstsq(x[a] - xm, y[a] - ym, rcond=None)[0]
        press, wrong = press + ((y[b] - ym - got) ** 2).sum(), wrong + int(((got > 0) != (y[b] > ym)).sum())
    q2 = 1 - press / ((y - y.mean()) ** 2).sum()
    assert list(cv["components"]) == list(range(1, 12))  # 12 features leave 11 orthogonal directions
    assert list(cv["q2"][7:]) == pytest.approx([q2] * 4, abs=1e-9) and list(cv["misclassified"][7:]) == [wrong] * 4


def test_f7_loadings_of_folds(spark, table, monkeypatch):
    from lumaspec.queries.latent import two as rows

    mine = {(r["fold"], r["j"]): r["value"] for r in wide.cv_loadings(rows(spark, table[0]), 1, 3).collect()}
    for module in (linalg, wide, tall):
        monkeypatch.setattr(module, "LIMIT", 10_000)
    monkeypatch.setattr(tall, "suits", lambda m: False)
    theirs = {(r["fold"], r["j"]): r["value"] for r in wide.cv_loadings(rows(spark, table[0]), 1, 3).collect()}
    assert mine.keys() == theirs.keys() and all(mine[k] == pytest.approx(theirs[k], abs=1e-9) for k in mine)


def test_f8_shares_of_opls(spark, table):
    _, z, y = two(table)
    m = latent.opls_arrays(z, y, 1)
    t = m["t"]
    left = m["corrected"] - np.outer(t, m["corrected"].T @ t / (t @ t))
    r = QUERIES["opls_explained"](spark, table[0]).first()
    assert (r["r2x"], r["r2y"]) == pytest.approx((1 - (left**2).sum() / (z**2).sum(), 1 - ((y - t * m["c"][-1]) ** 2).sum() / (y**2).sum()), abs=2e-6)


def test_f9_loadings_of_opls(spark, table):
    _, z, y = two(table)
    m = latent.opls_arrays(z, y, 1)
    p = z.T @ m["t"] / (m["t"] @ m["t"])
    rows = QUERIES["opls_loadings"](spark, table[0]).orderBy("j").collect()
    assert [r["j"] for r in rows] == list(range(6)) and rows[5]["corr"] is None
    for r in rows[:5]:
        j = r["j"]
        corr = p[j] * np.linalg.norm(m["t"]) / np.linalg.norm(z[:, j])
        assert (r["w"], r["p"], r["po1"], r["cov"], r["corr"]) == pytest.approx((m["w"][j], p[j], m["po"][0, j], p[j], corr), abs=2e-6)


def test_f10_scores_of_opls(spark, table):
    ids, z, y = two(table)
    m = latent.opls_arrays(z, y, 1)
    got = {r["sample_id"]: (r["t_pred"], r["t_ortho1"]) for r in QUERIES["opls_scores"](spark, table[0]).collect()}
    assert len(got) == 60
    assert all(got[i] == pytest.approx((m["t"][k], z[k] @ m["wo"][0]), abs=2e-6) for k, i in enumerate(ids))


def pls_of(table):
    """ids, centred features, centred response, scores (n x 2) and parts of a PLS model of two components."""
    ids, z, y = two(table)
    k = latent.pls_kernel(z.T @ z, z.T @ y, float(y @ y), 2)
    return ids, z, y, z @ k["rotations"], k


def test_f12_shares_of_pls(spark, table):
    _, z, y, t, k = pls_of(table)
    r = QUERIES["pls_explained"](spark, table[0]).first()
    left = z - t @ k["loadings"].T
    assert (r["r2x"], r["r2y"]) == pytest.approx((1 - (left**2).sum() / (z**2).sum(), 1 - ((y - t @ k["y_loadings"]) ** 2).sum() / (y @ y)), abs=2e-6)


def test_f14_fitted_response(spark, table):
    ids, _, _, t, k = pls_of(table)
    got = {r["sample_id"]: r["predicted"] for r in QUERIES["pls_fitted"](spark, table[0]).collect()}
    assert len(got) == 60 and all(got[i] == pytest.approx(0.5 + t[n] @ k["y_loadings"], abs=2e-6) for n, i in enumerate(ids))


def test_f15_loadings_of_pls(spark, table):
    k = pls_of(table)[-1]
    rows = QUERIES["pls_loadings"](spark, table[0]).orderBy("j").collect()
    assert len(rows) == 6
    for r in rows:
        assert [r["w1"], r["w2"], r["p1"], r["p2"]] == pytest.approx([*k["weights"][r["j"]], *k["loadings"][r["j"]]], abs=2e-6)


def test_f16_scores_of_pls(spark, table):
    ids, _, _, t, _ = pls_of(table)
    got = {r["sample_id"]: [r["t1"], r["t2"]] for r in QUERIES["pls_scores"](spark, table[0]).collect()}
    assert len(got) == 60 and all(got[i] == pytest.approx(list(t[n]), abs=2e-6) for n, i in enumerate(ids))


def test_f17_importances(spark, table):
    k = pls_of(table)[-1]
    share = k["tt"] * k["y_loadings"] ** 2
    want = np.sqrt(6 * (k["weights"] ** 2 @ share) / share.sum())
    rows = QUERIES["vip_two_components"](spark, table[0]).orderBy("j").collect()
    assert [r["vip"] for r in rows] == pytest.approx(list(want), abs=2e-6)


def test_f13_permutations(spark, table, monkeypatch):
    """The feature form draws the permutations of the sample form and scores them alike."""
    from lumaspec.queries.latent import two as rows

    x = rows(spark, table[0])
    mine, query = latent.permutation_test(x, 12).first(), QUERIES["permutation_p"](spark, table[0]).first()
    for module in (linalg, wide, tall):
        monkeypatch.setattr(module, "LIMIT", 10_000)
    monkeypatch.setattr(tall, "suits", lambda m: False)
    assert tuple(mine) == pytest.approx(tuple(latent.permutation_test(x, 12).first()), abs=1e-9)
    assert query["score"] == pytest.approx(mine["score"], abs=1e-9)

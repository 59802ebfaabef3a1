"""Queries take whole tables: every feature, label, sample and row."""

import numpy as np
import pytest

from lumaspec.catalogue import QUERIES


def embeddings(spark, folder, x, labels):
    rows = [(i, [float(v) for v in r], int(labels[i])) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    return str(folder), np.asarray(x, dtype=np.float32).astype(float)


def test_imputation_covers_all_features(spark, tmp_path):
    at, x = embeddings(spark, tmp_path, np.random.default_rng(3).normal(size=(40, 64)), np.arange(40) % 10)
    holes = (np.arange(40)[:, None] * 7 + np.arange(64)[None, :] * 13) % 97 == 0
    assert holes[:, 8:].any()
    want, y = x.copy(), np.where(holes, np.nan, x)
    for i, j in np.argwhere(holes):
        d = np.sqrt(np.nanmean((y - y[i]) ** 2, axis=1) * 64)
        near = [k for k in np.lexsort((np.arange(40), d)) if k != i and not holes[k, j]][:2]
        want[i, j] = x[near, j].mean()
    rows = QUERIES["knn_impute"](spark, at).collect()
    assert len(rows) == x.size
    got = np.full(x.shape, np.nan)
    for r in rows:
        got[r["sample_id"], r["j"]] = r["value"]
    assert got == pytest.approx(want, abs=1e-6)


def test_forest_is_validated_on_all_labels(spark, tmp_path, monkeypatch):
    from lumaspec.operators.ml import Classifier

    labels = np.repeat(np.arange(4), 9)
    at, _ = embeddings(spark, tmp_path, np.random.default_rng(4).normal(size=(36, 3)) + 9 * labels[:, None], labels)
    seen, fit = [], Classifier.fit
    monkeypatch.setattr(Classifier, "fit", lambda self, m: seen.append({r["grp"]: r["count"] for r in m.groupBy("grp").count().collect()}) or fit(self, m))
    rows = QUERIES["rf_cv"](spark, at).collect()
    assert seen == [dict.fromkeys(range(4), 6)] * 3
    assert len(rows) == 3 and all(r["accuracy"] > 0.9 and r["macro_f1"] > 0.9 for r in rows)


def test_every_sample_gets_a_cluster(spark, tmp_path):
    from lumaspec.operators import latent
    from lumaspec.plans.matrix import to_long
    from lumaspec.queries.columns import matrix

    group = np.arange(60) % 3
    at, x = embeddings(spark, tmp_path, np.random.default_rng(5).normal(size=(60, 4)) + 30 * group[:, None], group % 2)
    rows = sorted(QUERIES["hca_clusters"](spark, at).collect())
    assert [r["sample_id"] for r in rows] == list(range(60))
    assert len({(g, r["cluster"]) for g, r in zip(group, rows, strict=True)}) == 3
    ids, linkage, flat = latent.hca(to_long(matrix(spark, at)), 5)
    ids2, linkage2, flat2 = latent.hca_samples(matrix(spark, at), 5)
    assert ids == ids2 and list(flat) == list(flat2)
    assert np.array(linkage2) == pytest.approx(np.array(linkage), rel=1e-6)
    with pytest.raises(ValueError):
        latent.hca_samples(matrix(spark, at), 3, most=59)


def test_opls_judges_all_components(spark, tmp_path):
    from lumaspec.operators import latent
    from lumaspec.queries.columns import matrix

    rng = np.random.default_rng(101)
    y = np.repeat([0, 1], 40)
    x = rng.normal(size=(80, 14))
    x[:, 0] += 1.5 * y
    x = x @ rng.normal(size=(14, 14)) * np.geomspace(1, 30, 14)
    at, x = embeddings(spark, tmp_path, x, y)
    fold = np.concatenate([np.arange(40) // 14] * 2)
    wrong = np.zeros(13, dtype=int)  # 14 features leave 13 orthogonal directions
    for f in range(3):
        a, b = fold != f, fold == f
        mean, div, my = x[a].mean(0), np.sqrt(x[a].std(0)), y[a].mean()
        model = latent.opls_arrays((x[a] - mean) / div, y[a] - my, 14)
        for k in range(13):
            wrong[k] += ((latent.opls_predict(model, (x[b] - mean) / div, k + 1) > 0) != (y[b] > my)).sum()
    assert wrong.argmin() >= 10
    got = QUERIES["opls_da"](spark, at).first()
    assert (got["components"], got["misclassified"]) == (wrong.argmin() + 1, wrong.min())
    assert latent.opls_da(matrix(spark, at), 3, most=10).first()["components"] <= 10


def test_rotation_comes_from_all_rows(spark):
    from lumaspec.operators import latent

    n = 50_400  # more than the rows once taken
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.laplace(size=n), rng.uniform(-1, 1, n)]) @ np.array([[1.0, 0.5], [-0.3, 1.0]])
    x[:300] *= 40
    matrix = spark.createDataFrame([(i, 0, r) for i, r in enumerate(x.tolist())], "sample_id long, grp int, values array<double>")
    z = x - x.mean(0)
    val, vec = np.linalg.eigh(z.T @ z / n)
    white = vec[:, ::-1] / np.sqrt(val[::-1])
    z, w = z @ white, np.linalg.qr(np.random.default_rng(42).normal(size=(2, 2)))[0]
    for _ in range(200):
        g = np.tanh(z @ w.T)
        u, _, v = np.linalg.svd(g.T @ z / n - np.diag((1 - g**2).mean(0)) @ w)
        w, old = u @ v, w
        if np.max(np.abs(np.abs(np.sum(w * old, axis=1)) - 1)) < 1e-6:
            break
    want = z @ w.T
    got = np.array([[r["IC1"], r["IC2"]] for r in latent.ica(matrix, 2).orderBy("sample_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(want), rel=1e-5, abs=1e-6)


def test_autoencoder_trains_on_all_rows(spark):
    from lumaspec.operators.ml import Autoencoder

    x = np.random.default_rng(7).normal(size=(300, 2)) @ np.random.default_rng(8).normal(size=(2, 6))
    matrix = spark.createDataFrame([(i, 0, r) for i, r in enumerate(x.tolist())], "sample_id long, grp int, values array<double>")
    model = Autoencoder((8,), 2, epochs=1)
    model.fit(matrix)
    assert model.mean == pytest.approx(x.mean(0)) and model.sd == pytest.approx(x.std(0))
    seen = np.vstack(list(model._mini_batches(matrix, 0))) * model.sd + model.mean
    assert np.sort(seen[:, 0]) == pytest.approx(np.sort(x[:, 0]))
    error = lambda m: np.mean([r["error"] for r in m.encode(matrix).collect()])
    assert error(Autoencoder((8,), 2, epochs=12, rate=1e-2).fit(matrix)) < 0.5 * error(model)


def test_rolled_arrays_are_whole(spark, tmp_path):
    at, x = embeddings(spark, tmp_path, np.random.default_rng(9).normal(size=(4, 64)), np.zeros(4))
    got = {r["vec_id"]: r["rolled"] for r in QUERIES["array_roll"](spark, at).collect()}
    assert np.array([got[i] for i in range(4)]) == pytest.approx(np.roll(x, 5, axis=1), abs=1e-6)

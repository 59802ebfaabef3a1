"""Latent-variable models of few samples with many features, in the space of samples; PLS and OPLS of no fewer samples than features run in ``tall``.

The cluster scales the features and adds up the samples' cross products (n x n
numbers, whatever the number of features); PCA, PLS and OPLS run on them in the
driver; weights, loadings, importances and coefficients come back as one
aggregation over the scaled values, keyed by feature. Nothing of the features'
size leaves the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import f_quantile
from ..plans.matrix import to_long
from . import tall
from .latent import opls_arrays
from .linalg import LIMIT, block_array, feature_blocks, gram_of, sample_ids, scale_block
from .reports import signed_vip

POWERS = {"uv": 1.0, "pareto": 0.5, "mean": 0.0}


def scaled(matrix: DataFrame, scaling: str = "pareto") -> DataFrame:
    """sample_id, j, value: features centred and divided by a power of their deviation (constant ones by 1)."""
    long = to_long(matrix).select("sample_id", "j", "value")
    s = long.groupBy("j").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    by = F.when(F.col("_s") > 0, F.pow("_s", F.lit(POWERS[scaling]))).otherwise(1.0)
    return long.join(s, "j").select("sample_id", "j", ((F.col("value") - F.col("_m")) / by).alias("value"))


def project(matrix: DataFrame, ids: list, vectors: dict[str, np.ndarray], scaling: str) -> DataFrame:
    """j, norm (root of the sum of squares) and, for each vector over the samples, the sum of scaled value * entry: one pass over blocks of features, the vectors (at most ``LIMIT`` rows) with each task."""
    names, place, power = list(vectors), {s: i for i, s in enumerate(ids)}, POWERS[scaling]
    weights = np.array([vectors[n] for n in names]).T

    def part(b: pd.DataFrame) -> pd.DataFrame:
        z = scale_block(block_array(b, place), power)
        out = pd.DataFrame(z.T @ weights, columns=names)
        out.insert(0, "norm", np.sqrt((z * z).sum(0)))
        out.insert(0, "j", np.arange(z.shape[1]) + int(b["start"].iloc[0]))
        return out

    schema = "j long, norm double, " + ", ".join(f"`{n}` double" for n in names)
    return feature_blocks(matrix, len(ids)).groupBy("b").applyInPandas(part, schema)


def _score_table(matrix: DataFrame, ids: list, columns: dict[str, np.ndarray]) -> DataFrame:
    kind = matrix.schema["sample_id"].dataType.simpleString()
    rows = [(i, *(float(v[k]) for v in columns.values())) for k, i in enumerate(ids)]
    table = matrix.sparkSession.createDataFrame(rows, f"sample_id {kind}, " + ", ".join(f"`{n}` double" for n in columns))
    return matrix.select("sample_id", "grp").join(F.broadcast(table), "sample_id")


def response(matrix: DataFrame, ids: list, y: Column) -> np.ndarray:
    """Centred response of the samples, in order of ``ids`` (at most ``LIMIT`` rows)."""
    known = {r[0]: float(r[1]) for r in matrix.select("sample_id", y.cast("double")).collect()}
    v = np.array([known[i] for i in ids])
    return v - v.mean()


@dataclass
class WidePca:
    scores: DataFrame
    loadings: DataFrame
    explained: list[tuple[str, float, float]]
    t2: DataFrame


def pca(matrix: DataFrame, components: int = 2, scaling: str = "pareto", level: float = 0.95) -> WidePca:
    """Scores (PC1, ...), loadings by feature, explained shares, and Hotelling's T2 with whether it is inside the limit. The largest loading of a component is positive."""
    ids = sample_ids(matrix)
    k = gram_of(matrix, ids, POWERS[scaling])[0]
    n = len(ids)
    val, vec = np.linalg.eigh(k)
    order = np.argsort(-val)[: min(components, n - 1)]
    val, every = np.maximum(val[order], 1e-300), max(np.trace(k), 1e-300)
    t = vec[:, order] * np.sqrt(val)
    names = [f"PC{i + 1}" for i in range(len(order))]
    loadings = project(matrix, ids, {c: t[:, i] / val[i] for i, c in enumerate(names)}, scaling)
    top = loadings.agg(*[F.max_by(F.col(c), F.struct(F.round(F.abs(c), 12), -F.col("j"))).alias(c) for c in names]).first()
    sign = np.array([1.0 if top[c] >= 0 else -1.0 for c in names])
    t = t * sign
    loadings = loadings.select("j", *[(F.col(c) * float(s)).alias(c) for c, s in zip(names, sign, strict=True)])
    share = val / every
    a = len(names)
    limit = a * (n - 1) / (n - a) * f_quantile(level, a, n - a) if n > a else float("inf")
    t2 = (t * t / (val / max(n - 1, 1))).sum(axis=1)
    distances = _score_table(matrix, ids, {"t2": t2}).select("sample_id", "t2").withColumn("inside", F.col("t2") <= float(limit))
    return WidePca(_score_table(matrix, ids, {c: t[:, i] for i, c in enumerate(names)}), loadings, [(c, float(s), float(u)) for c, s, u in zip(names, share, np.cumsum(share), strict=True)], distances)


@dataclass
class WidePls:
    scores: DataFrame
    features: DataFrame
    r2x: float
    r2y: float
    fitted: DataFrame


def pls(matrix: DataFrame, y: Column, components: int = 2, scaling: str = "uv") -> WidePls:
    """One-response PLS: scores t1, ..., features (j, w1, ..., p1, ..., vip, coef of the scaled features), shares of x and y explained, fitted response."""
    if tall.suits(matrix):
        return WidePls(*tall.pls(matrix, y, components, scaling))
    ids = sample_ids(matrix)
    k = gram_of(matrix, ids, POWERS[scaling])[0]
    v = response(matrix, ids, y)
    mean = float(matrix.agg(F.avg(y.cast("double"))).first()[0])
    t, w, p, q, tt = [], [], [], [], []
    left = v.copy()  # the response in the deflated space of samples
    for _ in range(components):
        norm = np.sqrt(max(left @ k @ left, 0.0))
        if norm < 1e-12 * max(1.0, np.sqrt(np.trace(k)) * np.linalg.norm(v)):
            break
        s = k @ left / norm
        for u in t:
            s = s - u * (u @ s) / (u @ u)
        t.append(s)
        w.append(left / norm)
        tt.append(s @ s)
        p.append(s / tt[-1])
        q.append(v @ s / tt[-1])
        left = left - s * (s @ left) / tt[-1]
    if not t:
        raise ValueError("the response does not vary with any feature")
    tt, q = np.array(tt), np.array(q)
    weight, load = np.array(w).T, np.array(p).T
    inner = np.linalg.solve(load.T @ k @ weight, q)  # (P'W)^-1 q
    parts = {f"w{i + 1}": w[i] for i in range(len(t))} | {f"p{i + 1}": p[i] for i in range(len(t))} | {"coef": weight @ inner}
    features = project(matrix, ids, parts, scaling).drop("norm")
    share = tt * q**2
    explained = sum((F.col(f"w{i + 1}") * F.col(f"w{i + 1}") * float(s) for i, s in enumerate(share)), F.lit(0.0))
    size = features.agg(F.count("*")).first()[0]
    features = features.withColumn("vip", F.sqrt(explained * float(size / max(share.sum(), 1e-300))))
    r2x = float(sum(a * (b @ k @ b) for a, b in zip(tt, p, strict=True)) / max(np.trace(k), 1e-300))
    fitted = _score_table(matrix, ids, {"predicted": mean + np.array(t).T @ q}).select("sample_id", "predicted")
    return WidePls(_score_table(matrix, ids, {f"t{i + 1}": s for i, s in enumerate(t)}), features, r2x, float(share.sum() / max(v @ v, 1e-300)), fitted)


def embedded(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples x rank coordinates with the cross products ``k``, the matrix that turns a vector of these coordinates into a vector over the samples)."""
    val, vec = np.linalg.eigh(k)
    keep = val > 1e-12 * max(val.max(initial=0.0), 1e-300)
    root = np.sqrt(val[keep])
    return vec[:, keep] * root, vec[:, keep] / root


def _opls(k: np.ndarray, y: np.ndarray, components: int) -> tuple[dict, list[np.ndarray], dict[str, np.ndarray]]:
    """(model, orthogonal scores, vectors over the samples of the predictive weight and the orthogonal loadings)."""
    x, back = embedded(k)
    m = opls_arrays(x, y, components)
    scores, work = [], x.copy()
    for o, load in zip(m["wo"], m["po"], strict=True):
        scores.append(work @ o)
        work = work - np.outer(scores[-1], load)
    return m, scores, {"w": back @ m["w"]} | {f"po{i + 1}": back @ load for i, load in enumerate(m["po"])}


@dataclass
class WideOpls:
    scores: DataFrame
    features: DataFrame
    r2x: float
    r2y: float


def opls(matrix: DataFrame, y: Column, components: int = 1, scaling: str = "pareto") -> WideOpls:
    """Orthogonal PLS of one response: scores (t_pred, t_ortho1, ...), features (j, w, p, po1, ..., cov, corr), shares of x and y explained by the predictive and orthogonal parts."""
    if tall.suits(matrix):
        return WideOpls(*tall.opls(matrix, y, components, scaling))
    ids = sample_ids(matrix)
    k = gram_of(matrix, ids, POWERS[scaling])[0]
    v = response(matrix, ids, y)
    m, to, vectors = _opls(k, v, components)
    t = m["t"]
    tt = max(t @ t, 1e-300)
    parts = {"p": t / tt} | vectors
    features = project(matrix, ids, parts, scaling)
    # The predictive loading is taken from the corrected features: t is at right angles to the orthogonal scores.
    features = features.withColumn("cov", F.col("p")).withColumn("corr", F.when(F.col("norm") > 0, F.col("p") * float(np.sqrt(tt)) / F.col("norm"))).drop("norm")
    scores = {"t_pred": t} | {f"t_ortho{i + 1}": s for i, s in enumerate(to)}
    back = sum((s @ s) * (g @ k @ g) for s, g in zip([t, *to], [t / tt, *(vectors[f"po{i + 1}"] for i in range(len(to)))], strict=True))
    yrec = t * m["c"][-1]
    return WideOpls(_score_table(matrix, ids, scores), features, float(back / max(np.trace(k), 1e-300)), float(1 - ((v - yrec) ** 2).sum() / max(v @ v, 1e-300)))


def corrected(matrix: DataFrame, y: Column, components: int = 1, scaling: str = "pareto") -> DataFrame:
    """sample_id, j, value: scaled features less their parts along the orthogonal components."""
    if tall.suits(matrix):
        return tall.corrected(matrix, y, components, scaling)
    ids = sample_ids(matrix)
    k = gram_of(matrix, ids, POWERS[scaling])[0]
    _, to, vectors = _opls(k, response(matrix, ids, y), components)
    names = [f"_o{i}" for i in range(len(to))]
    if not names:
        return scaled(matrix, scaling)
    loads = project(matrix, ids, {n: vectors[f"po{i + 1}"] for i, n in enumerate(names)}, scaling).drop("norm")
    scores = _score_table(matrix, ids, {f"{n}s": t for n, t in zip(names, to, strict=True)}).drop("grp")
    part = sum((F.col(n) * F.col(f"{n}s") for n in names), F.lit(0.0))
    return scaled(matrix, scaling).join(loads, "j").join(F.broadcast(scores), "sample_id").select("sample_id", "j", (F.col("value") - part).alias("value"))


def opls_cv(matrix: DataFrame, kfold: int = 7, scaling: str = "pareto", most: int | None = None) -> pd.DataFrame:
    """components, q2, misclassified of a two-class model for each number of orthogonal components, over contiguous folds of each class.

    Each fold scales by its own training samples, so its cross products are its own: kfold matrices of samples squared reach the driver, which is checked. For no fewer samples than features they are of features squared.
    """
    if tall.suits(matrix):
        return tall.opls_cv(matrix, _classes(matrix), kfold, scaling, most)
    classes, ids, code = _two_classes(matrix)
    fold = _contiguous(code, kfold)
    grams = gram_of(matrix, ids, POWERS[scaling], fold, kfold)
    press, wrong = {}, {}
    for f in range(kfold):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        my = code[train].mean()
        x = embedded(grams[f])[0]
        m = opls_arrays(x[train], code[train] - my, min(len(train) - 1, x.shape[1], *([] if most is None else [most])))
        z, want = x[test], code[test] - my
        for c, b in enumerate(m["c"], 1):
            if c <= len(m["wo"]):
                z = z - np.outer(z @ m["wo"][c - 1], m["po"][c - 1])
            got = z @ m["w"] * b
            press.setdefault(c, []).append(((want - got) ** 2).sum())
            wrong.setdefault(c, []).append(int(((got > 0) != (want > 0)).sum()))
    ss = sum(((code[fold == f] - code.mean()) ** 2).sum() for f in range(kfold))
    rows = [(c, 1 - sum(p) / ss, sum(wrong[c])) for c, p in sorted(press.items()) if len(p) == kfold]
    return pd.DataFrame(rows, columns=["components", "q2", "misclassified"])


def cv_loadings(matrix: DataFrame, components: int = 1, kfold: int = 7, scaling: str = "pareto") -> DataFrame:
    """j, fold, value: predictive loadings of the models of each fold's training samples, for ``latent.jackknife``. Signs follow the class that stands second, so folds agree."""
    classes = _classes(matrix)
    dealt, y, out = tall.placed(matrix, kfold).withColumnRenamed("part", "_fold"), F.col("grp") == F.lit(classes[1]), None
    for f in range(kfold):
        one = opls(dealt.where(F.col("_fold") != f).drop("_fold"), y, components, scaling).features.select("j", F.lit(f).alias("fold"), F.col("p").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def _classes(matrix: DataFrame) -> list:
    classes = [r[0] for r in matrix.select("grp").distinct().collect()]
    if len(classes) != 2 or None in classes:
        raise ValueError("two classes are needed")
    return sorted(classes)


def _two_classes(matrix: DataFrame) -> tuple[list, list, np.ndarray]:
    rows = sorted(((r["sample_id"], r["grp"]) for r in matrix.select("sample_id", "grp").collect()), key=lambda r: r[0])  # at most LIMIT rows
    if len(rows) > LIMIT:
        raise ValueError(f"{len(rows)} samples: use the feature-by-feature form")
    classes = sorted({g for _, g in rows})
    if len(classes) != 2:
        raise ValueError("two classes are needed")
    return classes, [i for i, _ in rows], np.array([float(g == classes[1]) for _, g in rows])


def _contiguous(code: np.ndarray, kfold: int) -> np.ndarray:
    """Blocks of ceil(n / kfold) samples of each class in order."""
    fold = np.zeros(len(code), dtype=int)
    for c in (0.0, 1.0):
        at = np.flatnonzero(code == c)
        fold[at] = np.arange(len(at)) // max(1, -(-len(at) // kfold))
    return fold


@dataclass
class OplsDa:
    summary: DataFrame
    scores: DataFrame
    features: DataFrame
    model: WideOpls

    def important(self, threshold: float = 1.0) -> DataFrame:
        """Features whose importance reaches the threshold."""
        return self.features.where(F.col("vip") >= threshold)


def opls_da(matrix: DataFrame, components: int | None = None, kfold: int = 7, scaling: str = "pareto", vip_components: int = 2, threshold: float = 2.0) -> OplsDa:
    """The whole two-class analysis: summary (components, r2x, r2y, q2, misclassified, n), sample scores, and for each feature weights, loadings, covariance, correlation (S-plot), importance, signed importance and direction.

    ``components``: orthogonal components; chosen by the fewest misclassified of cross-validation if not given. Importances come from a PLS model of ``vip_components`` on unit-variance features.
    """
    classes = _classes(matrix)
    cv = opls_cv(matrix, kfold, scaling, components)
    if components is None:
        best = cv.sort_values(["misclassified", "components"]).iloc[0]
    else:
        best = cv[cv["components"] <= components].iloc[-1]
    y = (F.col("grp") == F.lit(classes[1])).cast("double")
    model = opls(matrix, y, int(best["components"]), scaling)
    importance = pls(matrix, y, vip_components, "uv").features.select("j", "vip", "coef")
    signed = signed_vip(importance, str(classes[0]), str(classes[1]), threshold)
    row = (int(best["components"]), model.r2x, model.r2y, float(best["q2"]), int(best["misclassified"]), matrix.count())
    summary = matrix.sparkSession.createDataFrame([row], "components int, r2x double, r2y double, q2 double, misclassified long, n long")
    return OplsDa(summary, model.scores, model.features.join(importance, "j").join(signed, "j"), model)


def lazy_opls_da(matrix: DataFrame, components: int | None = None, kfold: int = 7, scaling: str = "pareto", vip_components: int = 2, threshold: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(summaries, features) of every pair of classes (classes are few), with group1, group2."""
    classes = sorted(r[0] for r in matrix.select("grp").distinct().collect() if r[0] is not None)
    out: list[list[DataFrame]] = [[], []]
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            done = opls_da(matrix.where(F.col("grp").isin(a, b)), components, kfold, scaling, vip_components, threshold)
            kept = done.features.select("j", "cov", "corr", "vip", "signed_vip", "direction")
            for part, table in zip(out, (done.summary, kept), strict=True):
                part.append(table.select(F.lit(str(a)).alias("group1"), F.lit(str(b)).alias("group2"), "*"))
    if not out[0]:
        raise ValueError("at least two classes are needed")
    tables = []
    for part in out:
        whole = part[0]
        for d in part[1:]:
            whole = whole.unionByName(d)
        tables.append(whole)
    return tables[0], tables[1]


def pls_quality(matrix: DataFrame, y: Column, components: int = 2, scaling: str = "uv") -> pd.DataFrame:
    """One row: r2, rmse and leave-one-out q2 of a PLS regression. The features are scaled once over all samples, so every leave-one-out fit works on the same cross products, centred anew."""
    if tall.suits(matrix):
        return tall.pls_quality(matrix, y, components, scaling)
    ids = sample_ids(matrix)
    k = gram_of(matrix, ids, POWERS[scaling])[0]
    known = {r[0]: float(r[1]) for r in matrix.select("sample_id", y.cast("double")).collect()}
    v = np.array([known[i] for i in ids])
    n = len(ids)

    def fit(train: np.ndarray, at: np.ndarray) -> np.ndarray:
        kk = k[np.ix_(train, train)]
        kt = k[np.ix_(at, train)] - kk.mean(0)
        kt = kt - kt.mean(1, keepdims=True)
        kc = kk - kk.mean(0) - kk.mean(1, keepdims=True) + kk.mean()
        target = v[train] - v[train].mean()
        t, u, left = [], [], target.copy()
        for _ in range(components):
            s = kc @ left
            for z in t:
                s = s - z * (z @ s)
            size = np.linalg.norm(s)
            if size < 1e-12 * max(np.trace(kc), 1e-300):
                break
            t.append(s / size)
            u.append(left)
            left = left - t[-1] * (t[-1] @ left)
        if not t:
            return np.full(len(at), v[train].mean())
        tm, um = np.array(t).T, np.array(u).T
        return kt @ um @ np.linalg.solve(tm.T @ kc @ um, tm.T @ target) + v[train].mean()

    whole = fit(np.arange(n), np.arange(n))
    ss = max(((v - v.mean()) ** 2).sum(), 1e-300)
    loo = np.array([fit(np.delete(np.arange(n), i), np.array([i]))[0] for i in range(n)])
    return pd.DataFrame({"r2": [1 - ((v - whole) ** 2).sum() / ss], "rmse": [np.sqrt(((v - whole) ** 2).mean())], "q2": [1 - ((v - loo) ** 2).sum() / ss]})

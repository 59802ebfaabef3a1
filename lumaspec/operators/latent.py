"""Latent-variable models.

The cluster builds a cross-product matrix; the model is linear algebra on it in
the driver; scores are one pass over the samples with the coefficients as
literals or small broadcasts. Signs are fixed by the largest loading.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import f_quantile, t_quantile
from .linalg import class_moments, fixed_signs, gram, moments, packed_sums

SCALES = ("uv", "pareto", "mean", "minmax")


def _divisor(c: np.ndarray, n: int, mode: str) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
    power = {"uv": 1.0, "pareto": 0.5, "mean": 0.0}[mode]
    return np.where(sd > 0, np.where(sd > 0, sd, 1) ** power, 1.0)


def _project(matrix: DataFrame, mean: np.ndarray, weights: np.ndarray, names: list[str]) -> DataFrame:
    """sample_id, grp and one column of (values - mean) . weights for each column of ``weights``."""
    shared = matrix.sparkSession.sparkContext.broadcast((mean, weights))  # features x components, bounded by the model
    kinds = {c.name: c.dataType.simpleString() for c in matrix.schema}

    def run(batches):
        m, w = shared.value
        for b in batches:
            t = (np.vstack(b["values"].to_numpy()) - m) @ w if len(b) else np.zeros((0, w.shape[1]))
            yield pd.DataFrame({"sample_id": b["sample_id"], "grp": b["grp"], **{n: t[:, i] for i, n in enumerate(names)}})

    return matrix.select("sample_id", "grp", "values").mapInPandas(run, f"sample_id {kinds['sample_id']}, grp {kinds['grp']}, " + ", ".join(f"{n} double" for n in names))


@dataclass
class Pca:
    mean: np.ndarray
    divisor: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    ratios: np.ndarray
    n: int
    names: list[str] = field(default_factory=list)

    def scores(self, matrix: DataFrame) -> DataFrame:
        return _project(matrix, self.mean, self.loadings / self.divisor[:, None], self.names)

    def loading_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(j, *map(float, row)) for j, row in enumerate(self.loadings)], "j long, " + ", ".join(f"{n} double" for n in self.names))

    def explained(self, spark) -> DataFrame:
        rows = [(n, float(r), float(c)) for n, r, c in zip(self.names, self.ratios, np.cumsum(self.ratios), strict=True)]
        return spark.createDataFrame(rows, "component string, ratio double, cumulative double")

    def hotelling(self, matrix: DataFrame, level: float = 0.95) -> DataFrame:
        """sample_id, t2, inside: sum of squared scores over their variances against A (n - 1) / (n - A) F."""
        a = len(self.names)
        limit = a * (self.n - 1) / (self.n - a) * f_quantile(level, a, self.n - a)
        t2 = sum((F.col(n) * F.col(n) / float(v) for n, v in zip(self.names, self.variances, strict=True)), F.lit(0.0))
        return self.scores(matrix).select("sample_id", t2.alias("t2")).withColumn("inside", F.col("t2") <= limit)


def reconstruction_r2(model: Pca, matrix: DataFrame, subset: Column | None = None) -> float:
    """Mean over features of the share of the scaled features' variance that the components give back, on the rows of ``subset``."""
    rows = matrix if subset is None else matrix.where(subset)
    mean, div, load = model.mean, model.divisor, model.loadings

    def part(batches):
        sums = np.zeros((4, len(mean)))
        for b in batches:
            if len(b):
                z = (np.vstack(b["values"].to_numpy()) - mean) / div
                e = z - z @ load @ load.T
                sums += np.stack([np.full(len(mean), float(len(z))), z.sum(0), (z * z).sum(0), (e * e).sum(0)])
        yield pd.DataFrame({"i": [0], "data": [sums.tobytes()]})

    n, s, ss, e = packed_sums(rows.select("values").mapInPandas(part, "i long, data binary"))[0].reshape(4, -1)
    total = ss - s * s / np.maximum(n, 1)
    return float(np.mean(np.where(total > 0, 1 - e / np.where(total > 0, total, 1), 0.0)))


def pca(matrix: DataFrame, components: int = 2, scaling: str = "pareto") -> Pca:
    """Principal components of scaled features, from the covariance of features. NULL or NaN values are an error."""
    if not matrix.where(F.exists("values", lambda v: v.isNull() | F.isnan(v))).isEmpty():
        raise ValueError("missing values")
    n, mean, c = moments(matrix)
    d = _divisor(c, n, scaling)
    c = c / np.outer(d, d)
    val, vec = np.linalg.eigh(c)
    order = np.argsort(-val)[:components]
    w = vec[:, order] * fixed_signs(vec[:, order])
    return Pca(mean, d, w, val[order] / (n - 1), val[order] / max(val.sum(), 1e-300), n, [f"PC{i + 1}" for i in range(len(order))])


def pca_dual(long: DataFrame, components: int = 2) -> tuple[list, np.ndarray, np.ndarray]:
    """(sample ids, scores, explained ratios) of few samples of many features, from the sample-by-sample matrix of features centred by column."""
    mean = long.groupBy("j").agg(F.avg("value").alias("m"))
    ids, k = gram(long.join(mean, "j").select("sample_id", "j", (F.col("value") - F.col("m")).alias("value")))
    val, vec = np.linalg.eigh(k)
    order = np.argsort(-val)[:components]
    val = np.maximum(val, 0)
    t = vec[:, order] * np.sqrt(val[order])
    return ids, t * fixed_signs(t), val[order] / max(val.sum(), 1e-300)


def first_pls_component(matrix: DataFrame, y: Column) -> DataFrame:
    """j, w: weights of the first component of one response: w = X'y / |X'y| on centred data, one aggregation."""
    from ..plans.matrix import to_long

    long = to_long(matrix, y.cast("double").alias("y"))
    s = long.groupBy("j").agg((F.covar_pop("value", "y") * F.count("*")).alias("c"))
    norm = s.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return s.join(F.broadcast(norm), how="cross").select("j", F.when(F.col("norm") > 0, F.col("c") / F.col("norm")).alias("w"))  # one row


def s_plot(long: DataFrame, scores: DataFrame) -> DataFrame:
    """j, cov = t'x / t't, corr = t'x / (|t| |x|) with scores (sample_id, t)."""
    rows = long.join(scores.select("sample_id", "t"), "sample_id")
    s = rows.groupBy("j").agg(F.sum(F.col("t") * F.col("value")).alias("tx"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("value") * F.col("value")).alias("xx"))
    return s.select("j", F.when(F.col("tt") > 0, F.col("tx") / F.col("tt")).alias("cov"), F.when((F.col("tt") > 0) & (F.col("xx") > 0), F.col("tx") / F.sqrt(F.col("tt") * F.col("xx"))).alias("corr"))


def pls_kernel(c: np.ndarray, xy: np.ndarray, yy: float, components: int) -> dict[str, np.ndarray]:
    """One-response PLS from X'X, X'y and y'y: weights, loadings, y loadings, t't and coefficients after each component."""
    p = len(xy)
    w, pl, q, tt, r = (np.zeros((p, components)), np.zeros((p, components)), np.zeros(components), np.zeros(components), np.zeros((p, components)))
    s = xy.copy()
    for a in range(components):
        norm = np.linalg.norm(s)
        if norm < 1e-12 * max(1.0, np.sqrt(abs(yy))):
            w, pl, q, tt, r = w[:, :a], pl[:, :a], q[:a], tt[:a], r[:, :a]
            break
        w[:, a] = s / norm
        r[:, a] = w[:, a] - sum((pl[:, b] @ w[:, a] * r[:, b] for b in range(a)), np.zeros(p))
        cr = c @ r[:, a]
        tt[a] = r[:, a] @ cr
        if tt[a] <= 1e-300:
            w, pl, q, tt, r = w[:, :a], pl[:, :a], q[:a], tt[:a], r[:, :a]
            break
        pl[:, a] = cr / tt[a]
        q[a] = r[:, a] @ xy / tt[a]
        s = s - pl[:, a] * q[a] * tt[a]
    return {"weights": w, "loadings": pl, "y_loadings": q, "tt": tt, "rotations": r, "coef": np.cumsum(r * q, axis=1)}


def vip(weights: np.ndarray, y_loadings: np.ndarray, tt: np.ndarray) -> np.ndarray:
    """Importance of each feature; without explained y, zeros. The squares sum to the number of features."""
    s = tt * y_loadings**2
    total = s.sum()
    if total <= 0:
        return np.zeros(len(weights))
    norm = np.linalg.norm(weights, axis=0)
    return np.sqrt(len(weights) * ((weights / np.where(norm > 0, norm, 1)) ** 2 @ s) / total)


def _with_response(matrix: DataFrame, y: Column) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """(n, mean with y last, X'X, X'y, y'y), centred."""
    rows = matrix.withColumn("values", F.concat("values", F.array(y.cast("double"))))
    n, mean, c = moments(rows)
    return n, mean, c[:-1, :-1], c[:-1, -1], float(c[-1, -1])


@dataclass
class PlsModel:
    mean: np.ndarray
    divisor: np.ndarray
    y_mean: float
    y_divisor: float
    parts: dict
    r2: float
    vip: np.ndarray

    def scores(self, matrix: DataFrame) -> DataFrame:
        r = self.parts["rotations"]
        return _project(matrix, self.mean, r / self.divisor[:, None], [f"t{i + 1}" for i in range(r.shape[1])])

    def coefficients(self, spark) -> DataFrame:
        """j, coef: change of the response by one unit of the feature as given; ``offset`` is the response at zero."""
        b = self.parts["coef"][:, -1] / self.divisor * self.y_divisor
        return spark.createDataFrame([(j, float(v)) for j, v in enumerate(b)], "j long, coef double")

    @property
    def offset(self) -> float:
        return float(self.y_mean - self.mean @ (self.parts["coef"][:, -1] / self.divisor * self.y_divisor))

    def predict(self, matrix: DataFrame) -> DataFrame:
        b = self.parts["coef"][:, -1:] / self.divisor[:, None] * self.y_divisor
        return _project(matrix, self.mean, b, ["raw"]).withColumn("predicted", F.col("raw") + F.lit(self.y_mean)).drop("raw")


def pls(matrix: DataFrame, y: Column, components: int = 2, scaling: str = "uv") -> PlsModel:
    """One-response PLS on scaled features and response, with R2 and VIP."""
    n, mean, c, xy, yy = _with_response(matrix, y)
    d = _divisor(c, n, scaling)
    dy = np.sqrt(yy / n) or 1.0
    parts = pls_kernel(c / np.outer(d, d), xy / d / dy, yy / dy**2, components)
    r2 = float((parts["tt"] * parts["y_loadings"] ** 2).sum() / max(yy / dy**2, 1e-300))
    return PlsModel(mean[:-1], d, float(mean[-1]), float(dy), parts, r2, vip(parts["weights"], parts["y_loadings"], parts["tt"]))


def opls_arrays(x: np.ndarray, y: np.ndarray, components: int) -> dict[str, np.ndarray]:
    """Orthogonal PLS of one response on centred arrays: predictive weight, orthogonal weights and loadings, predictive scores and y weight after each removed component.

    The predictive loading turns towards ``w`` from component to component, until
    its orthogonal part is rounding alone. Without rounding, that part has the
    direction of the last orthogonal loading's part at right angles to all weights,
    reversed; it is taken from there, so late components are as exact as early ones.
    """
    w = x.T @ y
    w = w / max(np.linalg.norm(w), 1e-300)
    work, weights, po, c = x.copy(), w[None], [], []
    t = work @ w
    for _ in range(components):
        tt = t @ t
        if tt <= 1e-300:
            break
        p = -po[-1] if po else work.T @ t / tt
        o = p - (weights @ p) @ weights
        o = o - (weights @ o) @ weights  # what the first time left by rounding
        norm = np.linalg.norm(o)
        if norm <= 1e-10 * max(np.linalg.norm(p), 1e-300):
            break
        o = o / norm
        s = work @ o
        if s @ s <= 1e-300:
            break
        load = work.T @ s / (s @ s)
        work = work - np.outer(s, load)
        t = work @ w
        weights = np.vstack([weights, o])
        po.append(load)
        c.append(t @ y / max(t @ t, 1e-300))
    if not c:
        c.append(t @ y / max(t @ t, 1e-300))
    return {"w": w, "wo": weights[1:], "po": np.array(po).reshape(-1, len(w)), "c": np.array(c), "t": t, "corrected": work}


def opls_predict(model: dict, x: np.ndarray, k: int) -> np.ndarray:
    work = x.copy()
    for o, p in zip(model["wo"][:k], model["po"][:k], strict=True):
        work = work - np.outer(work @ o, p)
    return work @ model["w"] * model["c"][min(k, len(model["c"])) - 1]


def opls_da(matrix: DataFrame, kfold: int = 3, scaling: str = "pareto", most: int | None = None) -> DataFrame:
    """One row: components, r2y, q2, misclassified, n of a two-class model, components chosen by contiguous-fold cross-validation.

    All components of each fold are judged, or at most ``most``. Everything runs
    on the samples' cross products (``wide``), whatever the number of features.
    """
    from . import wide

    classes = sorted(r[0] for r in matrix.select("grp").distinct().collect())
    cv = wide.opls_cv(matrix, kfold, scaling, most)
    best = cv.sort_values(["misclassified", "components"]).iloc[0]
    model = wide.opls(matrix, F.col("grp") == F.lit(classes[-1]), int(best["components"]), scaling)
    row = (int(best["components"]), model.r2y, float(best["q2"]), int(best["misclassified"]), matrix.count())
    return matrix.sparkSession.createDataFrame([row], "components int, r2y double, q2 double, misclassified long, n long")


def permutation_test(matrix: DataFrame, permutations: int = 100, components: int = 2, kfold: int = 3, seed: int = 42) -> DataFrame:
    """One row: score, mean_permuted, p_value = (as good + 1) / (n + 1) of the cross-validated R2 of a two-class PLS model.

    Only labels are permuted: the workers share the samples' cross-product
    matrix and each takes some of the permutations. For no fewer samples than
    features the same permutations run on the features' cross products.
    """
    from ..plans.matrix import to_long
    from . import tall

    if tall.suits(matrix):
        return tall.permutation_test(matrix, sorted(r[0] for r in matrix.select("grp").distinct().collect()), permutations, components, kfold, seed)
    ids, k = gram(to_long(matrix))
    known = {r["sample_id"]: r["grp"] for r in matrix.select("sample_id", "grp").collect()}  # one label for each of at most 10,000 samples
    classes = sorted(set(known.values()))
    y0 = np.array([float(known[i] == classes[-1]) for i in ids])
    n = len(ids)
    fold = np.zeros(n, dtype=int)
    for c in (0.0, 1.0):
        at = np.flatnonzero(y0 == c)
        fold[at] = np.arange(len(at)) * kfold // max(len(at), 1)
    spark = matrix.sparkSession
    shared = spark.sparkContext.broadcast(k)

    def score(k: np.ndarray, y: np.ndarray) -> float:
        press = 0.0
        for f in range(kfold):
            a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            h = np.full((len(a), len(a)), 1 / len(a))
            kk = k[np.ix_(a, a)]
            kt = k[np.ix_(b, a)] - kk.mean(0)
            kt = kt - kt.mean(1, keepdims=True)
            kc = kk - h @ kk - kk @ h + h @ kk @ h
            v, my = y[a] - y[a].mean(), y[a].mean()
            u, t_all, u_all = v.copy(), [], []
            left = kc.copy()
            for _ in range(components):
                t = left @ u
                s = np.linalg.norm(t)
                if s < 1e-12:
                    break
                t = t / s
                t_all.append(t)
                u_all.append(u)
                p = np.eye(len(a)) - np.outer(t, t)
                left, u = p @ left @ p, p @ u
            if t_all:
                t, w = np.array(t_all).T, np.array(u_all).T
                pred = kt @ w @ np.linalg.pinv(t.T @ kc @ w) @ (t.T @ v) + my
            else:
                pred = np.full(len(b), my)
            press += float(((y[b] - pred) ** 2).sum())
        return 1 - press / max(float(((y - y.mean()) ** 2).sum()), 1e-300)

    def run(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                y = y0 if i == 0 else np.random.default_rng([seed, int(i)]).permutation(y0)
                out.append(score(shared.value, y))
            yield pd.DataFrame({"id": b["id"], "score": out})

    got = spark.range(permutations + 1).repartition(min(permutations + 1, 64)).mapInPandas(run, "id long, score double")
    real = F.max(F.when(F.col("id") == 0, F.col("score")))
    rows = got.agg(real.alias("score"), F.avg(F.when(F.col("id") > 0, F.col("score"))).alias("mean_permuted"), F.collect_list("score").alias("all"))
    better = F.size(F.filter("all", lambda s: s >= F.col("score")))  # counts the real one too
    return rows.select("score", "mean_permuted", (better / (permutations + 1)).alias("p_value"))


def lda(matrix: DataFrame, components: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(scores, explained ratios): directions that part the groups most, from group means and scatter within, ridged where it is singular."""
    classes = [r[0] for r in matrix.select("grp").distinct().collect()]
    sizes, means, within = class_moments(matrix, classes)
    n = sizes.sum()
    mean = sizes @ means / n
    within = within / max(n - len(classes), 1)
    between = (means - mean).T @ ((means - mean) * sizes[:, None]) / max(len(classes) - 1, 1)
    val, vec = np.linalg.eigh(within)
    white = vec / np.sqrt(np.maximum(val, 1e-10 * max(val.max(), 1e-300)))
    b, v = np.linalg.eigh(white.T @ between @ white)
    order = np.argsort(-b)[: components or len(classes) - 1]
    w = white @ v[:, order]
    w = w * fixed_signs(w)
    return _project(matrix, mean, w, [f"LD{i + 1}" for i in range(len(order))]), b[order] / max(b[b > 0].sum(), 1e-300)


def ica(matrix: DataFrame, components: int = 2, seed: int = 42, rounds: int = 200) -> DataFrame:
    """Independent components (symmetric fixed point, log cosh). Each round is a sum over all rows; the driver sees components x components numbers of each task."""
    n, mean, c = moments(matrix)
    val, vec = np.linalg.eigh(c / n)
    order = np.argsort(-val)[:components]
    white = vec[:, order] / np.sqrt(np.maximum(val[order], 1e-300))
    names = [f"IC{i + 1}" for i in range(components)]
    rows = _project(matrix, mean, white, names).select(*names).persist()
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(components, components)))[0]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all rows of the outer products of tanh and row, and of the derivatives."""

        def part(batches):
            gz, slope = np.zeros((components, components)), np.zeros(components)
            for b in batches:
                z = b.to_numpy()
                g = np.tanh(z @ w.T)
                gz, slope = gz + g.T @ z, slope + (1 - g**2).sum(0)
            yield pd.DataFrame({"gz": [gz.ravel().tolist()], "slope": [slope.tolist()]})

        got = rows.mapInPandas(part, "gz array<double>, slope array<double>").collect()
        return np.sum([r["gz"] for r in got], axis=0).reshape(components, components), np.sum([r["slope"] for r in got], axis=0)

    for _ in range(rounds):
        gz, slope = sums(w)
        new = gz / n - np.diag(slope / n) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        if np.max(np.abs(np.abs(np.sum(new * w, axis=1)) - 1)) < 1e-6:
            w = new
            break
        w = new
    rows.unpersist()
    full = white @ w.T
    return _project(matrix, mean, full * fixed_signs(full), names)


def hca(long: DataFrame, clusters: int = 3) -> tuple[list, list[tuple[int, int, float, int]], np.ndarray]:
    """(sample ids, linkage rows (a, b, height, size), cluster of each sample): Ward's method by nearest-neighbour chains on distances from the sample-by-sample matrix."""
    ids, k = gram(long)
    n = len(ids)
    d = np.maximum(np.diag(k)[:, None] + np.diag(k)[None, :] - 2 * k, 0)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, dtype=bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        y, x = chain.pop(), chain.pop()
        h = d[x, y]
        a, b = min(x, y), max(x, y)
        s = size
        new = ((s[a] + s) * d[a] + (s[b] + s) * d[b] - s * h) / (s[a] + s[b] + s)
        d[b], d[:, b] = new, new
        d[b, b] = np.inf
        alive[a] = False
        merges.append((a, b, float(np.sqrt(max(h, 0))), float(s[a] + s[b])))
        size[b] = s[a] + s[b]
    rows, flat = _tree(n, merges, clusters)
    return ids, rows, flat


def _tree(n: int, merges: list[tuple[int, int, float, float]], clusters: int) -> tuple[list[tuple[int, int, float, int]], np.ndarray]:
    """Linkage rows in order of height and the flat clusters of n samples, from merges in any order."""
    order = sorted(range(n - 1), key=lambda i: merges[i][2])
    name, rows = list(range(n)), []
    parent = list(range(2 * n - 1))
    head = list(range(n))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for step, i in enumerate(order):
        a, b, h, s = merges[i]
        ra, rb = find(a), find(b)
        rows.append((min(name[ra], name[rb]), max(name[ra], name[rb]), h, int(s)))
        parent[name[ra]] = parent[name[rb]] = n + step
        head[ra] = rb
        name[rb] = n + step
    label, top = {}, parent  # from the root down, each node's highest node below the cut
    for at in range(2 * n - 2, -1, -1):
        top[at] = top[parent[at]] if parent[at] != at and parent[at] < 2 * n - clusters else at
    flat = np.array([label.setdefault(top[i], len(label) + 1) for i in range(n)], dtype=int)
    return rows, flat


#: Numbers that a worker holds at once, and pairs of clusters up to which the driver looks for neighbours itself.
TILE, SMALL = 4_000_000, 40_000_000


def _nearest(queries: np.ndarray, x: np.ndarray, size: np.ndarray, sq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest cluster, squared Ward distance) of the clusters ``queries``, ties to the smaller number.

    Matrix products find what may be nearest within their rounding; those few are measured by plain differences, which are the same from both sides.
    """
    near, far = np.zeros(len(queries), dtype=int), np.zeros(len(queries))
    step = max(1, TILE // len(x))
    for first in range(0, len(queries), step):
        q = queries[first : first + step]
        g = x[q] @ x.T
        g *= -2
        g += sq[None, :]
        g += sq[q][:, None]
        g *= 1 / (1 / size[q][:, None] + 1 / size[None, :])  # |difference|^2 / (1/a + 1/b), half of the squared distance
        g[np.arange(len(q)), q] = np.inf
        slack = 1e-15 * (x.shape[1] + 100) * (sq[q] + sq.max()) * size[q]
        low = g.min(axis=1)
        row, at = np.nonzero(g <= (low + 2 * slack)[:, None])
        d, some = np.empty(len(row)), max(1, TILE // x.shape[1])
        for k in range(0, len(row), some):
            i, j = q[row[k : k + some]], at[k : k + some]
            d[k : k + some] = ((x[i] - x[j]) ** 2).sum(axis=1) * (2 * (size[i] * size[j]) / (size[i] + size[j]))
        order = np.lexsort((at, d, row))
        head = order[np.unique(row[order], return_index=True)[1]]
        near[first : first + step], far[first : first + step] = at[head], d[head]
    return near, far


def hca_samples(matrix: DataFrame, clusters: int = 3, most: int | None = None) -> tuple[list, list[tuple[int, int, float, int]], np.ndarray]:
    """As ``hca``, without a matrix of samples by samples: Ward distances come from the clusters' means and sizes.

    All pairs of clusters that are each other's nearest merge in each round,
    which gives the tree that merging the nearest pair again and again gives.
    Nearest clusters are looked for on the workers, for those alone whose
    nearest has gone. Equal samples merge first, at height 0. All samples reach
    the driver (samples x features numbers) and time grows with the square of
    the distinct samples; more than ``most`` of them are an error if it is given.
    """
    n = matrix.count()
    if most is not None and n > most:
        raise ValueError(f"{n} samples: more than the driver should cluster")
    got = matrix.orderBy("sample_id").select("sample_id", "values").toArrow()
    ids = got["sample_id"].to_pylist()
    if not n:
        return ids, [], np.zeros(0, dtype=int)
    x = np.vstack(got["values"].to_numpy()).astype(float) + 0.0
    if np.isnan(x).any():
        raise ValueError("missing values: impute them first")
    _, first, group, size = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    group, size = group.reshape(-1), size.astype(float)
    merges: list[tuple[int, int, float, float]] = []
    head, seen = first[group], np.zeros(len(first))
    for i in range(n):
        seen[group[i]] += 1
        if head[i] != i:
            merges.append((i, int(head[i]), 0.0, float(seen[group[i]])))
    number, x = first, x[first] - x.mean(0)  # each cluster stands under the number of one of its samples
    order = np.argsort(number)
    number, x, size = number[order], x[order], size[order]
    near, far = np.full(len(x), -1), np.zeros(len(x))
    while len(x) > 1:
        ask = np.flatnonzero(near < 0)
        near[ask], far[ask] = _nearest_of(matrix.sparkSession, ask, x, size)
        a = np.flatnonzero((near[near] == np.arange(len(x))) & (np.arange(len(x)) < near))
        if not len(a):  # equal distances of old and new clusters: ask all anew
            near[:] = -1
            continue
        b = near[a]
        total = size[a] + size[b]
        merges += [(int(number[i]), int(number[k]), float(np.sqrt(h)), float(s)) for i, k, h, s in zip(a, b, far[a], total, strict=True)]
        x[b] = (size[a][:, None] * x[a] + size[b][:, None] * x[b]) / total[:, None]
        size[b] = total
        gone, changed = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
        gone[a], changed[a], changed[b] = True, True, True
        near = np.where(changed | changed[near], -1, near)
        place = np.cumsum(~gone) - 1
        near = np.where(near >= 0, place[near], -1)[~gone]
        number, x, size, far = number[~gone], x[~gone], size[~gone], far[~gone]
    rows, flat = _tree(n, merges, clusters)
    return ids, rows, flat


def _nearest_of(spark, ask: np.ndarray, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_nearest``, on the workers where it is much."""
    sq = (x * x).sum(axis=1)
    if len(ask) * len(x) <= SMALL:
        return _nearest(ask, x, size, sq)
    shared = spark.sparkContext.broadcast((ask, x, size, sq))  # samples x features numbers, as in the driver
    width = max(64, min(4_096, -(-len(ask) // 64)))

    def part(batches):
        ask, x, size, sq = shared.value
        for b in batches:
            for i in b["id"]:
                near, far = _nearest(ask[i * width : (i + 1) * width], x, size, sq)
                yield pd.DataFrame({"i": [i], "near": [near.astype(np.int64).tobytes()], "far": [far.tobytes()]})

    parts = -(-len(ask) // width)
    got = sorted(spark.range(parts, numPartitions=parts).mapInPandas(part, "i long, near binary, far binary").collect(), key=lambda r: r["i"])
    shared.unpersist()
    return np.concatenate([np.frombuffer(r["near"], dtype=np.int64) for r in got]), np.concatenate([np.frombuffer(r["far"]) for r in got])


def jackknife(loadings: DataFrame, kfold: int, alpha: float = 0.05) -> DataFrame:
    """j, mean, half: mean and confidence half-width of each feature's loading over folds (j, fold, value), ordered by mean."""
    t = float(t_quantile(1 - alpha / 2, kfold - 1))
    return loadings.groupBy("j").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") * t).alias("half")).orderBy("mean", "j")

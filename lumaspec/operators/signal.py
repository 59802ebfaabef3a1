"""Operators on one spectrum at a time.

What an array expression can say stays in the JVM (filters, shifts, peak
windows); solvers and peak searches run in Arrow batches, row by row, with no
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def savgol_coefficients(window: int = 11, order: int = 2) -> np.ndarray:
    """(window, window): row i smooths at position i of a full window; the middle row is the filter."""
    x = np.arange(window) - window // 2
    a = np.vander(x.astype(float), order + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def savgol(values: Column, window: int = 11, order: int = 2) -> Column:
    """Moving polynomial smoothing; the ends are the polynomials of the first and last full windows."""
    h = savgol_coefficients(window, order)
    half = window // 2
    n = F.size(values)

    def dot(row: np.ndarray, part: Column) -> Column:
        return F.aggregate(F.zip_with(part, F.array(*[F.lit(float(c)) for c in row]), lambda v, c: v * c), F.lit(0.0), lambda s, x: s + x)

    inner = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: dot(h[half], F.slice(values, i, F.lit(window))))
    head = F.array(*[dot(h[i], F.slice(values, 1, window)) for i in range(half)])
    tail = F.array(*[dot(h[i], F.slice(values, n - window + 1, F.lit(window))) for i in range(half + 1, window)])
    return F.when(n >= window, F.concat(head, inner, tail)).otherwise(values)


def savgol_array(y: np.ndarray, window: int = 11, order: int = 2) -> np.ndarray:
    if len(y) < window:
        return y.copy()
    h, half = savgol_coefficients(window, order), window // 2
    return np.concatenate([h[:half] @ y[:window], np.convolve(y, h[half][::-1], "valid"), h[half + 1 :] @ y[-window:]])


def _maxima(y: np.ndarray) -> np.ndarray:
    """Places of local maxima; a flat top counts at its middle."""
    if len(y) < 3:
        return np.zeros(0, dtype=int)
    start = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))  # of runs of equal values
    end = np.append(start[1:], len(y)) - 1
    v = y[start]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (start[top] + end[top]) // 2


def _drops(heights: np.ndarray, valleys: np.ndarray) -> np.ndarray:
    """For each point the least valley on the way to the next higher point before it (or to the end); ``valleys[i]`` lies between points i and i + 1."""
    out, stack = np.empty(len(heights)), []
    for i, h in enumerate(heights.tolist()):
        low = valleys[i - 1] if i else h
        while stack and stack[-1][0] <= h:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append((h, low))
    return out


def find_peaks(y: np.ndarray, prominence: float = 0.0, width: float = 0.0) -> list[tuple[int, float, float]]:
    """(place, prominence, width at half prominence) of local maxima; a flat top counts at its middle. Prominences come from one pass over the maxima with a stack of higher ones."""
    y = np.asarray(y, dtype=float)
    n, places = len(y), _maxima(y)
    if not len(places):
        return []
    points = np.concatenate([[0], places, [n - 1]])
    valleys = np.minimum.reduceat(y, points[:-1])
    valleys = np.minimum(valleys, y[points[1:]])
    left = _drops(y[points], valleys)[1:-1]
    right = _drops(y[points][::-1], valleys[::-1])[::-1][1:-1]
    prom = y[places] - np.maximum(left, right)
    out = []
    for p, h in zip(places[prom >= prominence].tolist(), prom[prom >= prominence].tolist(), strict=True):
        level = y[p] - h / 2
        lo = p
        while lo > 0 and y[lo] > level:
            lo -= 1
        hi = p
        while hi < n - 1 and y[hi] > level:
            hi += 1
        x0 = lo + (level - y[lo]) / (y[lo + 1] - y[lo]) if y[lo] < level and y[lo + 1] != y[lo] else float(lo)
        x1 = hi - (level - y[hi]) / (y[hi - 1] - y[hi]) if y[hi] < level and y[hi - 1] != y[hi] else float(hi)
        if x1 - x0 >= width:
            out.append((p, float(h), float(x1 - x0)))
    return out


def _whittaker(y: np.ndarray, w: np.ndarray, lam: float) -> np.ndarray:
    """Minimises sum w (y - z)**2 + lam * sum of squared second differences for each row: pentadiagonal systems by banded LDL', all rows at once."""
    rows, n = y.shape
    if n < 3:
        return y.copy()
    d0 = np.full(n, 6.0)
    d0[[0, -1]], d0[[1, -2]] = 1.0, 5.0
    d1 = np.full(n - 1, -4.0)
    d1[[0, -1]] = -2.0
    if n == 3:
        d0, d1 = np.array([1.0, 4.0, 1.0]), np.array([-2.0, -2.0])
    a, b = np.ascontiguousarray((w + lam * d0).T), lam * d1  # by point, so that a step is one row operation
    z = np.ascontiguousarray((w * y).T)
    d, e, f = np.empty((n, rows)), np.zeros((n, rows)), np.zeros((n, rows))
    for i in range(n):
        d[i] = a[i]
        if i > 0:
            d[i] -= e[i - 1] ** 2 * d[i - 1]
            z[i] -= e[i - 1] * z[i - 1]
        if i > 1:
            d[i] -= f[i - 2] ** 2 * d[i - 2]
            z[i] -= f[i - 2] * z[i - 2]
        if i < n - 1:
            e[i] = (b[i] - (e[i - 1] * f[i - 1] * d[i - 1] if i > 0 else 0.0)) / d[i]
        if i < n - 2:
            f[i] = lam / d[i]
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= e[i] * z[i + 1]
        if i < n - 2:
            z[i] -= f[i] * z[i + 2]
    return z.T


def rubberband(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower convex hull, interpolated."""
    order = np.argsort(x, kind="stable")
    hull: list[int] = []
    for i in order:
        while len(hull) > 1 and (x[hull[-1]] - x[hull[-2]]) * (y[i] - y[hull[-2]]) <= (y[hull[-1]] - y[hull[-2]]) * (x[i] - x[hull[-2]]):
            hull.pop()
        hull.append(i)
    return np.interp(x, x[hull], y[hull])


REWEIGHTED = ("asls", "arpls", "airpls")


def _reweighted(y: np.ndarray, method: str, lam: float, p: float, max_iter: int, tol: float) -> np.ndarray:
    """Baselines of rows by reweighted Whittaker smoothing; a row that has settled leaves the batch."""
    z, w = y.copy(), np.ones_like(y)
    left = np.arange(len(y))
    for i in range(1, max_iter + 1):
        if not len(left):
            break
        z[left] = _whittaker(y[left], w[left], lam)
        d = y[left] - z[left]
        below = d < 0
        n = np.maximum(below.sum(axis=1, keepdims=True), 1)
        settled = np.zeros(len(left), dtype=bool)
        if method == "asls":
            new = np.where(d > 0, p, 1 - p)
        elif method == "arpls":
            m = np.where(below, d, 0).sum(axis=1, keepdims=True) / n
            s = np.sqrt(np.where(below, (d - m) ** 2, 0).sum(axis=1, keepdims=True) / n)
            new = 1 / (1 + np.exp(np.clip(2 * (d - (2 * s - m)) / np.maximum(s, 1e-300), -500, 500)))
        else:
            total = np.abs(np.where(below, d, 0)).sum(axis=1, keepdims=True)
            settled = total[:, 0] < 0.001 * np.abs(y[left]).sum(axis=1)
            new = np.where(d >= 0, 0.0, np.exp(np.clip(i * np.abs(d) / np.maximum(total, 1e-300), 0, 500)))
        old = w[left]
        settled |= np.linalg.norm(new - old, axis=1) <= tol * np.maximum(np.linalg.norm(old, axis=1), 1e-300)
        w[left] = new
        left = left[~settled]
    return z


def baseline(y: np.ndarray, x: np.ndarray | None = None, method: str = "asls", lam: float = 1e7, p: float = 0.01, max_iter: int | None = None, order: int = 3, tol: float = 1e-3) -> np.ndarray:
    """Baseline of one spectrum, or of each row of a matrix. asls, arpls, airpls: reweighted Whittaker smoothing (at most 30 rounds); modpoly, imodpoly: clipped polynomials (at most 50); rubberband: lower hull; median: median."""
    y = np.nan_to_num(np.asarray(y, dtype=float))
    if method in REWEIGHTED:
        got = _reweighted(np.atleast_2d(y), method, lam, p, 30 if max_iter is None else max_iter, tol)
        return got[0] if y.ndim == 1 else got
    if y.ndim == 2:
        return np.array([baseline(row, x, method, lam, p, max_iter, order, tol) for row in y]).reshape(y.shape)
    n = len(y)
    x = np.linspace(-1, 1, n) if x is None else np.asarray(x, dtype=float)
    if method == "rubberband":
        return rubberband(x, y)
    if method == "median":
        return np.full(n, np.median(y))
    if method not in ("modpoly", "imodpoly"):
        raise ValueError(f"unknown baseline method {method}")
    t = (x - x.min()) / max(np.ptp(x), 1e-300) * 2 - 1
    v = np.vander(t, order + 1)
    work, old = y.copy(), None
    for _ in range(50 if max_iter is None else max_iter):
        z = v @ np.linalg.lstsq(v, work, rcond=None)[0]
        sd = float(np.std(work - z)) if method == "imodpoly" else 0.0
        if old is not None and np.linalg.norm(z - old) <= tol * max(np.linalg.norm(old), 1e-300):
            break
        old, work = z, np.minimum(work, z + sd)
    return z


def map_spectra(matrix: DataFrame, f, whole: bool = False) -> DataFrame:
    """Array form with ``f(values) -> values`` applied to each row in Arrow batches; with ``whole`` to the matrix of all rows of one length in a batch."""
    kinds = {c.name: c.dataType.simpleString() for c in matrix.schema}

    def rows(values: pd.Series) -> list:
        out: list = [None] * len(values)
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(values):
            if v is not None:
                by_size.setdefault(len(v), []).append(i)
        for at in by_size.values():
            got = f(np.array([values.iloc[i] for i in at], dtype=float))
            for i, v in zip(at, got, strict=True):
                out[i] = v.tolist()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["values"] = rows(b["values"]) if whole else [None if v is None else f(np.asarray(v, dtype=float)).tolist() for v in b["values"]]
            yield b

    return matrix.select("sample_id", "grp", "values").mapInPandas(run, f"sample_id {kinds['sample_id']}, grp {kinds['grp']}, values array<double>")


def baseline_correct(matrix: DataFrame, method: str = "asls", return_baseline: bool = False, axis: np.ndarray | None = None, **options) -> DataFrame:
    """Spectra less their baselines, or the baselines; ``axis``: coordinates for the polynomials and the hull."""
    fit = lambda y: baseline(y, axis, method, **options)
    return map_spectra(matrix, fit if return_baseline else lambda y: np.nan_to_num(y) - fit(y), whole=True)


def interpolate_to(matrix: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """Spectra on another axis; ends are held."""
    order = np.argsort(old)
    return map_spectra(matrix, lambda y: np.interp(new, old[order], y[order]))


#: Range searched and target of each reference.
REFERENCES = {
    "tsp": (-0.2, 0.2, 0.0),
    "acetate": (1.8, 2.2, 1.91),
    "glucose": (5.0, 5.4, 5.23),
    "alanine": (1.2, 1.6, 1.48),
    "formate": (8.0, 8.4, 8.44),
}
#: Least prominence of the two peaks whose mean calibrates glucose and alanine.
PROMINENCE = 0.01


def peak_positions(matrix: DataFrame, axis: DataFrame, low: float, high: float, tallest: int = 1) -> DataFrame:
    """sample_id, position: coordinate of the largest value in a range, or the mean of the ``tallest`` largest."""
    from ..plans.matrix import to_long

    inside = axis.where(F.col("coord").between(low, high))
    rows = to_long(matrix).join(F.broadcast(inside), "j")  # one row for each feature of a range
    if tallest == 1:
        return rows.groupBy("sample_id").agg(F.max_by("coord", F.struct("value", -F.col("j"))).alias("position"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("value", "coord")), asc=False), 1, tallest)
    return rows.groupBy("sample_id").agg(F.aggregate(F.transform(top, lambda t: t["coord"]), F.lit(0.0), lambda s, x: s + x / tallest).alias("position"))


def calibrate(matrix: DataFrame, axis: np.ndarray, reference: str = "tsp", span: tuple[float, float] | None = None, target: float | None = None) -> DataFrame:
    """Spectra shifted so that the reference peak stands at its target, interpolated on the same axis, ends held.

    A known reference has its own range and target. Any other name (``custom``)
    takes ``span`` and ``target``; without a target the middle of the span is it.
    Glucose and alanine take the mean of their two tallest peaks, one peak if
    there is one, else the largest value. A range without points is an error.
    """
    axis = np.asarray(axis, dtype=float)
    if reference in REFERENCES:
        low, high, goal = REFERENCES[reference]
    elif span is None or (reference == "custom" and target is None):
        raise ValueError("a custom reference needs a range and a target")
    else:
        low, high = span
        goal = (low + high) / 2 if target is None else float(target)
    inside = np.flatnonzero((axis >= low) & (axis <= high))
    if not len(inside):
        raise ValueError(f"the axis has no point from {low} to {high}")
    order = np.argsort(axis, kind="stable")

    def f(y: np.ndarray) -> np.ndarray:
        part = y[inside]
        peaks = [p for p, _, _ in find_peaks(part, PROMINENCE)] if reference in ("glucose", "alanine") else []
        if peaks:
            tallest = sorted(peaks, key=lambda p: (part[p], p))[-2:]
            at = float(np.mean(axis[inside[tallest]]))
        else:
            at = float(axis[inside[int(np.argmax(part))]])
        return np.interp(axis + (at - goal), axis[order], y[order])

    return map_spectra(matrix, f)


def best_shift(template: np.ndarray, query: np.ndarray, most: int) -> int:
    """Shift s in -most .. most with the largest sum of template[i] * query[i + s]; the first of equals."""
    n = len(template)
    best, at = -np.inf, 0
    for s in range(-most, most + 1):
        a, b = max(0, -s), min(n, n - s)
        c = float(template[a:b] @ query[a + s : b + s]) if b > a else 0.0
        if c > best:
            best, at = c, s
    return at


def align(matrix: DataFrame, axis: np.ndarray, windows: list[tuple[float, float]], max_shift: float = 0.02, reference: str = "median", mode: str = "corrective") -> tuple[DataFrame, DataFrame]:
    """(aligned spectra, (sample_id, window, shift)). Each window of at least 5 points is rotated by its best shift against the reference spectrum.

    ``corrective`` rotates by -s, which brings the peak onto the reference;
    ``as_published`` rotates by +s. Windows may be given in either order.
    """
    from ..plans.matrix import to_long

    centre = F.median("value") if reference == "median" else F.avg("value")
    ref = np.array([r["v"] for r in to_long(matrix).groupBy("j").agg(centre.alias("v")).orderBy("j").collect()], dtype=float)
    step = abs(float(np.median(np.diff(axis)))) if len(axis) > 1 else 1.0
    most = max(1, round(max_shift / step))
    cuts = [np.flatnonzero((axis >= min(w)) & (axis <= max(w))) for w in windows]
    sign = -1 if mode == "corrective" else 1

    def shifts(y: np.ndarray) -> list[int]:
        out = []
        for c in cuts:
            if len(c) < 5:
                out.append(0)
                continue
            t, q = ref[c] - ref[c].mean(), y[c] - y[c].mean()
            t, q = t / (t.std() or 1.0), q / (q.std() or 1.0)
            out.append(best_shift(t, q, most))
        return out

    kinds = {c.name: c.dataType.simpleString() for c in matrix.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values, moved = [], []
            for v in b["values"]:
                y = np.asarray(v, dtype=float).copy()
                s = shifts(y)
                for c, k in zip(cuts, s, strict=True):
                    if len(c) >= 5:
                        y[c] = np.roll(y[c], sign * k)
                values.append(y.tolist())
                moved.append(s)
            yield pd.DataFrame({"sample_id": b["sample_id"], "grp": b["grp"], "values": values, "shifts": moved})

    done = matrix.select("sample_id", "grp", "values").mapInPandas(run, f"sample_id {kinds['sample_id']}, grp {kinds['grp']}, values array<double>, shifts array<int>")
    return done.drop("shifts"), done.select("sample_id", F.posexplode("shifts").alias("window", "shift"))


def multiplets(matrix: DataFrame, axis: np.ndarray, prominence: float = 0.01, width: float = 3.0, gap: float = 0.03) -> DataFrame:
    """sample_id, start, end, center, n_peaks, pattern: peaks of the smoothed spectrum grouped where neighbours are at most ``gap`` apart."""
    from ..functions.scalars import multiplet_pattern

    kind = matrix.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, float(axis[p]), float(y[p])) for k, y in ((k, savgol_array(np.asarray(v, dtype=float))) for k, v in zip(b["sample_id"], b["values"], strict=True)) for p, _, _ in find_peaks(y, prominence, width)]
            yield pd.DataFrame(rows, columns=["sample_id", "coord", "height"])

    from .joins import islands

    peaks = islands(matrix.select("sample_id", "values").mapInPandas(run, f"sample_id {kind}, coord double, height double"), ["sample_id"], "coord", gap)
    g = peaks.groupBy("sample_id", "island").agg(F.min("coord").alias("start"), F.max("coord").alias("end"), (F.sum(F.col("coord") * F.col("height")) / F.sum("height")).alias("center"), F.sort_array(F.collect_list(F.struct("coord", "height"))).alias("p"))
    pattern = multiplet_pattern(F.transform("p", lambda r: r["coord"]), F.transform("p", lambda r: r["height"]))
    return g.select("sample_id", "start", "end", "center", F.size("p").alias("n_peaks"), pattern.alias("pattern"))


def auto_windows(reference: DataFrame, axis: np.ndarray, top: int = 30) -> DataFrame:
    """start, end of windows around the ``top`` multiplets of largest area of one reference spectrum (array form, one row), overlapping ones joined."""
    from .joins import merge_intervals

    y = np.asarray(reference.first()["values"], dtype=float)
    order = np.argsort(axis)
    x, v = axis[order], y[order]
    rows = []
    for r in multiplets(reference, axis).collect():
        half = max(0.005, 1.5 * abs(r["end"] - r["start"])) / 2
        a, b = r["center"] - half, r["center"] + half
        c = (x >= a) & (x <= b)
        area = float(np.sum((v[c][1:] + v[c][:-1]) / 2 * np.diff(x[c]))) if c.sum() > 1 else 0.0
        rows.append((area, a, b))
    best = sorted(rows, key=lambda r: (-r[0], r[1]))[:top]
    spark = reference.sparkSession
    table = spark.createDataFrame([(0, a, b) for _, a, b in best], "k int, start double, end double")
    return merge_intervals(table, ["k"], "start", "end").select("start", "end")


def process_fid(re: np.ndarray, im: np.ndarray, points: int, delay: int = 0, phase: tuple[float, float] | str | None = "acme") -> np.ndarray:
    """Real spectrum of one signal: the first ``delay`` points (digital filter) rotated to the end, zero-filled to ``points``, transformed and phased (degrees, or by entropy)."""
    z = np.roll(np.asarray(re) + 1j * np.asarray(im), -delay)
    z = np.concatenate([z, np.zeros(max(0, points - len(z)))])[:points]
    spectrum = np.fft.fftshift(np.fft.fft(z))[::-1]
    ramp = np.arange(points) / points

    def phased(p: np.ndarray) -> np.ndarray:
        return (spectrum * np.exp(1j * np.deg2rad(p[0] + p[1] * ramp))).real

    if phase == "acme":
        return phased(simplex(lambda p: entropy(phased(p)), np.zeros(2), 20.0))
    return phased(np.array(phase if phase is not None else (0.0, 0.0)))


def entropy(y: np.ndarray) -> float:
    """Entropy of the derivative plus a penalty for negative parts: least for a well-phased spectrum."""
    d = np.abs(np.diff(y))
    h = d / max(d.sum(), 1e-300)
    h = np.where(h == 0, 1.0, h)
    neg = y[y < 0]
    return float(-(h * np.log(h)).sum() + 1000 * (neg**2).sum() / max(len(y), 1) / max(np.abs(y).max(), 1e-300) ** 2)


def simplex(f, start: np.ndarray, step: float, rounds: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Least point of ``f`` by the downhill simplex."""
    pts = [np.array(start, dtype=float)] + [start + step * np.eye(len(start))[i] for i in range(len(start))]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol):
            break
        centre = np.mean(pts[:-1], axis=0)
        out = centre + (centre - pts[-1])
        fo = f(out)
        if fo < val[0]:
            far = centre + 2 * (centre - pts[-1])
            ff = f(far)
            pts[-1], val[-1] = (far, ff) if ff < fo else (out, fo)
        elif fo < val[-2]:
            pts[-1], val[-1] = out, fo
        else:
            near = centre + 0.5 * (pts[-1] - centre)
            fn = f(near)
            if fn < val[-1]:
                pts[-1], val[-1] = near, fn
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def process_fids(fids: DataFrame, points: int, delay: int = 0, phase: tuple[float, float] | str | None = "acme") -> DataFrame:
    """Array form from (sample_id, re, im)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sample_id": b["sample_id"], "grp": None, "values": [process_fid(r, i, points, delay, phase).tolist() for r, i in zip(b["re"], b["im"], strict=True)]})

    return fids.select("sample_id", "re", "im").mapInPandas(run, "sample_id string, grp string, values array<double>")

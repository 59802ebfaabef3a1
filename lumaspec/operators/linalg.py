"""Cross-product matrices built by the cluster, small enough for the driver.

``covariance`` (features x features) suits many samples of few features,
``gram`` (samples x samples) few samples of many features. Both check the
side that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 10_000
#: Numbers that a worker holds of one block of features.
BLOCK_NUMBERS = 400_000


def packed_sums(parts: DataFrame, salts: int = 32) -> dict[int, np.ndarray]:
    """``parts`` (i, data: doubles as bytes) added up by i on the cluster, in two levels, and collected: one row for each i."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b["i"], b["data"], strict=True):
                x = np.frombuffer(data)
                if i in sums:
                    sums[i] += x
                else:
                    sums[i] = x.copy()
        if sums:
            yield pd.DataFrame({"i": list(sums), "data": [x.tobytes() for x in sums.values()]})

    kind = "i long, data binary"
    salted = parts.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(salts)))
    once = salted.repartition("i", "_s").select("i", "data").mapInPandas(add, kind)
    return {r["i"]: np.frombuffer(r["data"]) for r in once.repartition("i").mapInPandas(add, kind).collect()}


def moments(matrix: DataFrame, rows: int = 256) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean of each feature, sum of outer products of centred rows). Means first, then the products by blocks of ``rows`` features, all added up on the cluster."""
    size = matrix.agg(F.max(F.size("values")).alias("p"), F.count("*").alias("n")).first()
    p, n = size["p"] or 0, size["n"]
    if p > LIMIT:
        raise ValueError(f"{p} features: use the sample-by-sample form (operators.wide)")
    if not n or not p:
        return 0, np.zeros(p), np.zeros((p, p))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros(p)
        for b in batches:
            if len(b):
                s += np.vstack(b["values"].to_numpy()).sum(0)
        yield pd.DataFrame({"i": [0], "data": [s.tobytes()]})

    mean = packed_sums(matrix.select("values").mapInPandas(total, "i long, data binary"))[0] / n

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((p, p))
        for b in batches:
            if len(b):
                x = np.vstack(b["values"].to_numpy()) - mean
                c += x.T @ x
        for a in range(0, p, rows):
            yield pd.DataFrame({"i": [a // rows], "data": [c[a : a + rows].tobytes()]})

    sums = packed_sums(matrix.select("values").mapInPandas(products, "i long, data binary"))
    return n, mean, np.concatenate([sums[i].reshape(-1, p) for i in range(len(sums))])


def moments_of(matrix: DataFrame, groups: int, rows: int = 256, numbers: int = 50_000_000) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(size, mean, sum of outer products about its own mean) of each group 0 .. ``groups`` - 1 of the column ``part``: one pass for the means, one for the products of as many groups as a worker holds (``numbers``)."""
    p = matrix.agg(F.max(F.size("values"))).first()[0] or 0

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((groups, p + 1))
        for b in batches:
            for g, some in b.groupby("part"):
                s[int(g)] += np.append(np.vstack(some["values"].to_numpy()).sum(0), len(some))
        yield pd.DataFrame({"i": range(groups), "data": [x.tobytes() for x in s]})

    cells = matrix.select("part", "values")
    sums = packed_sums(cells.mapInPandas(total, "i long, data binary"))
    sizes = np.array([sums[g][p] for g in range(groups)])
    means = np.array([sums[g][:p] for g in range(groups)]) / np.maximum(sizes, 1)[:, None]
    step, per, out = max(1, numbers // max(p * p, 1)), -(-p // rows), []
    for first in range(0, groups, step):
        mine = range(first, min(first + step, groups))

        def products(batches: Iterator[pd.DataFrame], mine: range = mine) -> Iterator[pd.DataFrame]:
            c = {g: np.zeros((p, p)) for g in mine}
            for b in batches:
                for g, some in b.groupby("part"):
                    x = np.vstack(some["values"].to_numpy()) - means[int(g)]
                    c[int(g)] += x.T @ x
            for g in mine:
                yield pd.DataFrame({"i": range(g * per, g * per + per), "data": [c[g][a : a + rows].tobytes() for a in range(0, p, rows)]})

        got = packed_sums(cells.where(F.col("part").between(mine[0], mine[-1])).mapInPandas(products, "i long, data binary"))
        out += [np.concatenate([got[g * per + i].reshape(-1, p) for i in range(per)]) for g in mine]
    return sizes, means, out


def _dense(b: pd.DataFrame, place: dict, block: int) -> np.ndarray:
    x = np.zeros((len(place), block))
    x[[place[s] for s in b["sample_id"]], (b["j"] % block).to_numpy()] = b["value"].to_numpy()
    return x


def _row_blocks(k: np.ndarray, first: int, rows: int = 512) -> pd.DataFrame:
    starts = range(0, len(k), rows)
    return pd.DataFrame({"i": [first + a // rows for a in starts], "data": [k[a : a + rows].tobytes() for a in starts]})


def gram(long: DataFrame, block: int = 512) -> tuple[list, np.ndarray]:
    """(sample ids in order, sum over features of outer products of samples) of a complete long form, feature block by feature block."""
    ids = [r[0] for r in long.select("sample_id").distinct().orderBy("sample_id").limit(LIMIT + 1).collect()]
    n = len(ids)
    if n > LIMIT:
        raise ValueError(f"over {LIMIT} samples: use the feature-by-feature form")
    place = {s: i for i, s in enumerate(ids)}

    def part(b: pd.DataFrame) -> pd.DataFrame:
        x = _dense(b, place, block)
        return _row_blocks(x @ x.T, 0)

    blocks = long.select(F.floor(F.col("j") / block).alias("b"), "sample_id", "j", "value").groupBy("b").applyInPandas(part, "i long, data binary")
    sums = packed_sums(blocks)
    return ids, np.concatenate([sums[i].reshape(-1, n) for i in range(len(sums))]) if sums else np.zeros((n, n))


def feature_blocks(matrix: DataFrame, n: int) -> DataFrame:
    """b, start, sample_id, part: each sample's values in runs of features, as wide as ``n`` samples of them fit a worker (``BLOCK_NUMBERS``)."""
    width = max(64, BLOCK_NUMBERS // max(n, 1))
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("values") / width).cast("int") - 1), lambda b: F.struct(b.alias("b"), (b * width).alias("start"), F.slice("values", b * width + 1, F.lit(width)).alias("part")))
    return matrix.where(F.size("values") > 0).select("sample_id", F.explode(runs).alias("r")).select("r.b", "r.start", "sample_id", "r.part")


def block_array(b: pd.DataFrame, place: dict) -> np.ndarray:
    """Samples x features of one block, samples in the order of ``place``."""
    x = np.empty((len(place), len(b["part"].iloc[0])))
    x[[place[s] for s in b["sample_id"]]] = np.vstack(b["part"].to_numpy())
    return x


def scale_block(x: np.ndarray, power: float, by: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Features centred and divided by a power of their deviation over the samples ``by`` (constant ones by 1)."""
    sd = x[by].std(0)
    return (x - x[by].mean(0)) / np.where(sd > 0, np.where(sd > 0, sd, 1) ** power, 1.0)


def sample_ids(matrix: DataFrame) -> list:
    ids = [r[0] for r in matrix.select("sample_id").orderBy("sample_id").limit(LIMIT + 1).collect()]
    if len(ids) > LIMIT:
        raise ValueError(f"over {LIMIT} samples: use the feature-by-feature form")
    if len(set(ids)) < len(ids):
        raise ValueError("sample ids repeat")
    return ids


def gram_of(matrix: DataFrame, ids: list, power: float, folds: np.ndarray | None = None, kfold: int = 1) -> list[np.ndarray]:
    """Cross products of all samples over scaled features; with ``folds`` one matrix for each fold, scaled by the samples outside it. A block's scaling needs that block alone."""
    n = len(ids)
    if n * n * 8 * kfold > 4_000_000_000:
        raise ValueError(f"{kfold} matrices of {n} x {n} are too large for the driver")
    place, per = {s: i for i, s in enumerate(ids)}, -(-n // 512)  # row blocks of a fold

    def part(b: pd.DataFrame) -> pd.DataFrame:
        x, out = block_array(b, place), []
        for f in range(kfold):
            z = scale_block(x, power, slice(None) if folds is None else folds != f)
            out.append(_row_blocks(z @ z.T, f * per))
        return pd.concat(out)

    sums = packed_sums(feature_blocks(matrix, n).groupBy("b").applyInPandas(part, "i long, data binary"))
    return [np.concatenate([sums[f * per + i].reshape(-1, n) for i in range(per)]) if sums else np.zeros((n, n)) for f in range(kfold)]


def class_moments(matrix: DataFrame, classes: list, rows_of: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of each class, its mean, sum over all rows of outer products about their class's mean), from one pass for the means and one for the products."""
    p = matrix.agg(F.max(F.size("values"))).first()[0] or 0
    if p > LIMIT:
        raise ValueError(f"{p} features: use the sample-by-sample form (operators.wide)")
    number = {c: i for i, c in enumerate(classes)}

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((len(classes), p + 1))
        for b in batches:
            for g, rows in b.groupby("grp", dropna=False):
                s[number[g if g == g else None], :p] += np.vstack(rows["values"].to_numpy()).sum(0)
                s[number[g if g == g else None], p] += len(rows)
        yield pd.DataFrame({"i": range(len(classes)), "data": [x.tobytes() for x in s]})

    rows = matrix.select("grp", "values")
    sums = packed_sums(rows.mapInPandas(total, "i long, data binary"))
    sizes = np.array([sums[i][p] for i in range(len(classes))])
    means = np.array([sums[i][:p] for i in range(len(classes))]) / np.maximum(sizes, 1)[:, None]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((p, p))
        for b in batches:
            for g, part in b.groupby("grp", dropna=False):
                x = np.vstack(part["values"].to_numpy()) - means[number[g if g == g else None]]
                c += x.T @ x
        for a in range(0, p, rows_of):
            yield pd.DataFrame({"i": [a // rows_of], "data": [c[a : a + rows_of].tobytes()]})

    within = packed_sums(rows.mapInPandas(products, "i long, data binary"))
    return sizes, means, np.concatenate([within[i].reshape(-1, p) for i in range(len(within))])


def fixed_signs(loadings: np.ndarray) -> np.ndarray:
    """+1 or -1 for each column, so that its largest |entry| (the first of equals) is positive."""
    at = np.argmax(np.abs(loadings), axis=0)
    s = np.sign(loadings[at, np.arange(loadings.shape[1])])
    return np.where(s == 0, 1.0, s)

"""Scaling of features and normalisation of samples.

Statistics of features are one aggregation of the long form, joined back by j;
statistics of samples are array expressions within a row and need no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let, unit_values
from ..plans.matrix import to_arrays, to_long
from .colstats import column_stats

POWERS = {"uv": 1.0, "pareto": 0.5, "mean": 0.0}


def with_stats(long: DataFrame) -> DataFrame:
    """Long form with its features' statistics. The statistics have one row for each feature; the planner broadcasts them if they are small."""
    return long.join(column_stats(long).drop("n"), "j")


def scale(long: DataFrame, mode: str = "pareto") -> DataFrame:
    """uv, pareto or mean: (x - mean) / sd**power with the population deviation, constant features divided by 1. minmax: (x - least) / range, NULL for constant features."""
    rows = with_stats(long)
    if mode == "minmax":
        width = F.col("high") - F.col("low")
        value = F.when(width > 0, (F.col("value") - F.col("low")) / width)
    elif mode in POWERS:
        power = F.pow("std0", F.lit(POWERS[mode]))
        value = (F.col("value") - F.col("mean")) / F.when(F.col("std0") > 0, power).otherwise(1.0)
    else:
        raise ValueError(f"unknown scaling {mode}")
    return rows.select("sample_id", "grp", "j", value.alias("value"))


def unscale(scaled: DataFrame, stats: DataFrame, mode: str = "uv") -> DataFrame:
    """Undoes ``scale`` of uv, pareto or mean with the ``column_stats`` it used."""
    rows = scaled.join(stats.select("j", "mean", "std0"), "j")
    back = F.col("value") * F.when(F.col("std0") > 0, F.pow("std0", F.lit(POWERS[mode]))).otherwise(1.0) + F.col("mean")
    return rows.select("sample_id", "grp", "j", back.alias("value"))


def merge_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """(j, n, mean, m2) of two disjoint sets of rows joined: the state of a scaler that is fitted in parts."""
    both = a.unionByName(b)
    total = both.groupBy("j").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    spread = both.alias("p").join(total.alias("t"), "j").groupBy("j").agg(F.sum(F.col("p.m2") + F.col("p.n") * F.pow(F.col("p.mean") - F.col("t.mean"), 2)).alias("m2"))
    return total.join(spread, "j")


def zscore(long: DataFrame, sample_sd: bool = False) -> DataFrame:
    """(x - mean) / sd, population deviation unless ``sample_sd``; constant features NULL."""
    rows = with_stats(long)
    sd = F.sqrt("var") if sample_sd else F.col("std0")
    return rows.select("sample_id", "grp", "j", F.when(sd > 0, (F.col("value") - F.col("mean")) / sd).alias("value"))


def divide_by_sd(long: DataFrame) -> DataFrame:
    """x / sd (n - 1)."""
    return with_stats(long).select("sample_id", "grp", "j", F.when(F.col("var") > 0, F.col("value") / F.sqrt("var")).alias("value"))


def percent_of_total(long: DataFrame) -> DataFrame:
    """Each feature's values as parts of 100; NULL for a sum of 0."""
    return with_stats(long).select("sample_id", "grp", "j", F.when(F.col("total") != 0, F.col("value") / F.col("total") * 100).alias("value"))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value
    if high is not None:
        out = F.when(out.isNotNull(), F.least(out, F.lit(high)))
    if low is not None:
        out = F.when(out.isNotNull(), F.greatest(out, F.lit(low)))
    return out


def pqn(long: DataFrame, reference: Column | None = None, zero_reference_gives: str = "input") -> DataFrame:
    """Probabilistic quotient normalisation.

    The reference spectrum is the median of all rows, or of those that
    ``reference`` selects. A sample's quotient is the median of value / reference
    over features whose reference is not 0; without such a feature it is 1
    (``input``) or the output is 0 (``zero``). A quotient of 0 gives 0.
    """
    base = long if reference is None else long.where(reference)
    ref = base.groupBy("j").agg(F.median("value").alias("ref"))
    rows = long.join(ref, "j")
    quotient = rows.groupBy("sample_id").agg(F.median(F.when(F.col("ref") != 0, F.col("value") / F.col("ref"))).alias("q"))
    missing = F.lit(1.0) if zero_reference_gives == "input" else F.lit(0.0)
    quotient = quotient.withColumn("q", F.coalesce("q", missing))
    return rows.join(quotient, "sample_id").select("sample_id", "grp", "j", F.coalesce(F.when(F.col("q") != 0, F.col("value") / F.col("q")), F.lit(0.0)).alias("value"))


def snv_rows(matrix: DataFrame) -> DataFrame:
    """Standard normal variate of each sample (the usual form): centred and divided by the sample's own population deviation."""
    scaled = let(F.sqrt(F.size("values").cast("double")), lambda root: F.transform(unit_values(F.col("values")), lambda v: v * root))
    return matrix.select("sample_id", "grp", scaled.alias("values"))


def centre_features(long: DataFrame) -> DataFrame:
    mean = long.groupBy("j").agg(F.avg("value").alias("mean"))
    return long.join(mean, "j").select("sample_id", "grp", "j", (F.col("value") - F.col("mean")).alias("value"))


def msc(long: DataFrame) -> DataFrame:
    """Features centred, samples divided by their population deviation, features centred again."""
    first = centre_features(long)
    sd = first.groupBy("sample_id").agg(F.stddev_pop("value").alias("sd"))
    scaled = first.join(sd, "sample_id").select("sample_id", "grp", "j", F.when(F.col("sd") > 0, F.col("value") / F.col("sd")).alias("value"))
    return centre_features(scaled)


def snv_pqn(long: DataFrame, centre: bool = False) -> DataFrame:
    """Samples divided by their median, less their mean; ``centre`` centres the features after."""
    per = long.groupBy("sample_id").agg(F.median("value").alias("q"), F.avg("value").alias("m"))
    rows = long.join(per, "sample_id").select("sample_id", "grp", "j", F.when(F.col("q") != 0, F.col("value") / F.col("q") - F.col("m") / F.col("q")).alias("value"))
    return centre_features(rows) if centre else rows


#: Numbers of one block of samples in the search for neighbours.
NEIGHBOUR_NUMBERS = 500_000


def knn_impute(long: DataFrame, k: int = 2) -> DataFrame:
    """Missing values (NULL) replaced by the mean of the k nearest samples that have the feature.

    Distance over features present in both, scaled up to all features; ties go
    to the smaller sample. Samples that miss something are compared with all
    samples, block by block, and each block offers its k nearest for each hole.
    A value without a donor takes the feature's mean.
    """
    present = long.where(F.col("value").isNotNull())
    holes = long.where(F.col("value").isNull()).select("sample_id", "grp", "j")
    size = long.agg(F.countDistinct("j").alias("p"), F.countDistinct("sample_id").alias("n")).first()
    p, blocks = size["p"] or 1, max(1, -(-(size["n"] or 1) * (size["p"] or 1) // NEIGHBOUR_NUMBERS))
    rows = long.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("r"))
    rows = rows.select("sample_id", F.transform("r", lambda x: x["j"]).alias("js"), F.transform("r", lambda x: x["value"]).alias("values"), F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = rows.where(F.exists("values", lambda v: v.isNull())).select("sample_id", "js", "values", F.col("own").alias("part"), every.alias("block"))
    gives = rows.select("sample_id", "js", "values", F.col("own").alias("block"), every.alias("part"))

    def numbers(t: pd.DataFrame, features: np.ndarray) -> np.ndarray:
        out = np.full((len(t), len(features)), np.nan)
        for i, (js, v) in enumerate(zip(t["js"], t["values"], strict=True)):
            out[i, np.searchsorted(features, js)] = np.array(v, dtype=float)
        return out

    def offer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("sample_id")
            features = np.unique(np.concatenate([*left["js"], *right["js"]]))
            x, y, donor = numbers(left, features), numbers(right, features), right["sample_id"].to_numpy()
            for i, sample in enumerate(left["sample_id"]):
                shared = ~np.isnan(x[i]) & ~np.isnan(y)
                n = shared.sum(axis=1)
                d = np.where(n > 0, np.sqrt(p / np.maximum(n, 1) * np.where(shared, (x[i] - y) ** 2, 0).sum(axis=1)), np.inf)
                d[donor == sample] = np.inf
                order = np.argsort(d, kind="stable")
                order = order[np.isfinite(d[order])]
                for h in np.flatnonzero(np.isnan(x[i])):
                    best = order[~np.isnan(y[order, h])][:k]
                    out += [(sample, int(features[h]), float(d[b]), donor[b], float(y[b, h])) for b in best]
        return pd.DataFrame(out, columns=["sample_id", "j", "d", "donor", "value"])

    kind = long.schema["sample_id"].dataType.simpleString()
    offers = asks.groupBy("part", "block").cogroup(gives.groupBy("part", "block")).applyInPandas(offer, f"sample_id {kind}, j long, d double, donor {kind}, value double")
    near = offers.withColumn("_r", F.row_number().over(Window.partitionBy("sample_id", "j").orderBy("d", "donor"))).where(F.col("_r") <= k)
    filled = near.groupBy("sample_id", "j").agg(F.avg("value").alias("fill"))
    mean = present.groupBy("j").agg(F.avg("value").alias("mean"))
    got = holes.join(filled, ["sample_id", "j"], "left").join(mean, "j", "left").select("sample_id", "grp", "j", F.coalesce("fill", "mean").alias("value"))
    return present.select("sample_id", "grp", "j", "value").unionByName(got)


def row_scale(long: DataFrame, mode: str = "zscore") -> DataFrame:
    """Heat-map scaling of features: zscore (n - 1) or minmax, with 0 spread taken as 1, or none."""
    if mode == "none":
        return long
    rows = with_stats(long)
    if mode == "zscore":
        sd = F.sqrt("var")
        value = (F.col("value") - F.col("mean")) / F.when(sd > 0, sd).otherwise(1.0)
    else:
        width = F.col("high") - F.col("low")
        value = (F.col("value") - F.col("low")) / F.when(width > 0, width).otherwise(1.0)
    return rows.select("sample_id", "grp", "j", value.alias("value"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["to_arrays", "to_long"]

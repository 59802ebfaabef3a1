"""Statistics of features and of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unit_values
from ..plans.matrix import to_long


def column_stats(long: DataFrame, by_group: bool = False) -> DataFrame:
    """n, mean, variance (n - 1), population deviation, least, largest and sum of each feature, in one aggregation."""
    keys = ["j", "grp"] if by_group else ["j"]
    v = F.col("value")
    return long.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.stddev_pop(v).alias("std0"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)


def anchor_correlation(matrix: DataFrame, anchor: int) -> DataFrame:
    """j, n, r, t: each feature's Pearson correlation with one feature, and its t statistic on n - 2 degrees.

    The anchor's value travels in the row it belongs to, so there is no join.
    Constant features, or a constant anchor, give NULL.
    """
    long = to_long(matrix, F.get("values", F.lit(anchor)).alias("anchor")).where("value IS NOT NULL AND anchor IS NOT NULL")
    stats = long.groupBy("j").agg(F.count("*").alias("n"), F.covar_pop("value", "anchor").alias("c"), F.stddev_pop("value").alias("s"), F.stddev_pop("anchor").alias("s0"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), safe_ratio(F.col("c"), F.col("s") * F.col("s0"))))
    stats = stats.select("j", "n", F.when((F.col("s") > 1e-12) & (F.col("s0") > 1e-12), r).alias("r"))
    return stats.withColumn("t", F.when((F.col("n") > 2) & (F.abs("r") < 1), F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))


def top_variance(long: DataFrame, n: int) -> DataFrame:
    """The n features of largest variance, ties to the smaller j."""
    return long.groupBy("j").agg(F.var_samp("value").alias("var")).orderBy(F.desc("var"), "j").limit(n)


def feature_preselection(long: DataFrame, percentile: float = 20.0, method: str = "variance") -> DataFrame:
    """j, score of features whose variance or interquartile range reaches the given percentile of all scores."""
    if method not in ("variance", "iqr"):
        raise ValueError("method must be 'variance' or 'iqr'")
    score = F.var_samp("value") if method == "variance" else F.percentile("value", 0.75) - F.percentile("value", 0.25)
    scores = long.groupBy("j").agg(score.alias("score"))
    cut = scores.agg(F.percentile("score", percentile / 100).alias("cut"))
    return scores.join(F.broadcast(cut), how="cross").where("score >= cut").select("j", "score")  # cut is one row


def correlation_matrix(matrix: DataFrame, features: list[int]) -> DataFrame:
    """j1, j2, r for j1 < j2 of a short list of features; pairs are made within a row, without a join."""
    kept = F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.get("values", F.lit(j)).alias("v")) for j in sorted(features)])
    pairs = F.flatten(F.transform(kept, lambda a: F.transform(F.filter(kept, lambda b: b["j"] > a["j"]), lambda b: F.struct(a["j"].alias("j1"), b["j"].alias("j2"), a["v"].alias("x"), b["v"].alias("y")))))
    rows = matrix.select(F.explode(pairs).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    stats = rows.groupBy("j1", "j2").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return stats.select("j1", "j2", safe_ratio(F.col("c"), F.col("sx") * F.col("sy")).alias("r"))


#: Ranges into which the values of one key are cut, so that a key's order is not one task's work.
RANGES = 64


def in_ranges(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """Rows with ``_range``: the number of the range of ``value`` they lie in, between approximate quantiles of the whole column. Equal values share a range."""
    ends = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1_000).alias("_ends"))
    place = F.size(F.filter(F.coalesce("_ends", F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")), lambda e: e < F.col(value)))
    return df.join(F.broadcast(ends), how="cross").withColumn("_range", place).drop("_ends")  # ends: one row


def running_before(df: DataFrame, keys: list[str], value: str, amounts: list[str], descending: bool = False) -> DataFrame:
    """Rows of distinct ``value`` within their keys, with ``<amount>_before``: the sum over the rows of smaller (larger) values, as a sum within the row's range and the sums of the ranges before it."""
    rows = in_ranges(df, value)
    by = F.desc if descending else F.asc
    inner = Window.partitionBy(*keys, "_range").orderBy(by(value)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(by("_range")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows of a key
    sums = rows.groupBy(*keys, "_range").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    sums = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_{a}").over(outer), F.lit(0)).alias(f"_{a}") for a in amounts])
    rows = rows.select("*", *[F.coalesce(F.sum(a).over(inner), F.lit(0)).alias(f"_{a}_in") for a in amounts]).join(sums, [*keys, "_range"])
    return rows.select(*df.columns, *[(F.col(f"_{a}_in") + F.col(f"_{a}")).alias(f"{a}_before") for a in amounts])


def average_ranks(df: DataFrame, keys: list[str], value: str, count: str | None = None) -> DataFrame:
    """Distinct values of each key with their count and average rank; a row stands for ``count`` rows if a column is named.

    Values are counted first, so sorting sees distinct values only, and a key's values are sorted range by range.
    """
    counts = df.groupBy(*keys, value).agg((F.sum(count) if count else F.count("*")).alias("ties"))
    ranked = running_before(counts.where(F.col(value).isNotNull()), keys, value, ["ties"])
    return ranked.withColumn("rank", F.col("ties_before") + (F.col("ties") + 1) / 2).drop("ties_before")


def rank_transform(long: DataFrame) -> DataFrame:
    """Long form with each value replaced by its average rank in its feature."""
    ranks = average_ranks(long.where("value IS NOT NULL"), ["j"], "value")
    return long.join(ranks, ["j", "value"]).select("sample_id", "grp", "j", F.col("rank").cast("double").alias("value"))


def group_profile(long: DataFrame, how: str = "mean") -> DataFrame:
    """j, grp, value, sd: mean or median spectrum of each group; a group of one has sd 0."""
    centre = F.avg("value") if how == "mean" else F.median("value")
    return long.groupBy("j", "grp").agg(centre.alias("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def trajectory(df: DataFrame, group: str, time: str, value: str, centre: str = "mean", spread: str = "sem") -> DataFrame:
    """Mean or median of each group at each time, with its standard error or deviation."""
    middle = F.avg(value) if centre == "mean" else F.median(value)
    sd = F.stddev_samp(value)
    around = sd / F.sqrt(F.count(value)) if spread == "sem" else sd
    return df.groupBy(group, time).agg(middle.alias("centre"), around.alias("spread"), F.count(value).alias("n"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Five-number summary, 1.5 IQR whisker limits and count of each group."""
    q = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"), F.count(value).alias("n"))
    iqr = F.col("q")[3] - F.col("q")[1]
    return q.select(group, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))], (F.col("q")[1] - 1.5 * iqr).alias("whisker_low"), (F.col("q")[3] + 1.5 * iqr).alias("whisker_high"))


def covariance_ellipse(df: DataFrame, group: str, x: str, y: str, n_std: float = 1.96) -> DataFrame:
    """Centre, half axes and angle of each group's covariance ellipse (n - 1)."""
    s = df.groupBy(group).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.covar_samp(x, y).alias("c"))
    half = F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.pow("c", 2))
    mid = (F.col("a") + F.col("b")) / 2
    return s.select(group, "cx", "cy", (n_std * F.sqrt(mid + half)).alias("major"), (n_std * F.sqrt(F.greatest(mid - half, F.lit(0.0)))).alias("minor"), (0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))).alias("angle"))


def ellipse_path(ellipses: DataFrame, group: str, points: int = 100) -> DataFrame:
    """Points of each ellipse, for a plot."""
    t = F.col("i") * (2 * 3.141592653589793 / (points - 1))
    path = ellipses.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x, y = F.col("major") * F.cos(t), F.col("minor") * F.sin(t)
    return path.select(group, "i", (F.col("cx") + x * F.cos("angle") - y * F.sin("angle")).alias("x"), (F.col("cy") + x * F.sin("angle") + y * F.cos("angle")).alias("y"))


def mean_sample_correlation(matrix: DataFrame) -> DataFrame:
    """sample_id and mean Pearson correlation of its spectrum with all other spectra.

    With z a spectrum centred and scaled to length 1, the mean over others is
    (z . sum of all z - 1) / (n - 1): linear in the samples instead of quadratic.
    """
    unit = matrix.select("sample_id", "grp", unit_values(F.col("values")).alias("values")).where("values IS NOT NULL")
    totals = to_long(unit).groupBy("j").agg(F.sum("value").alias("total"))
    n = unit.agg(F.count("*").alias("n"))
    rows = to_long(unit).join(totals, "j").groupBy("sample_id").agg(F.sum(F.col("value") * F.col("total")).alias("s"))
    return rows.join(F.broadcast(n), how="cross").select("sample_id", F.when(F.col("n") > 1, (F.col("s") - 1) / (F.col("n") - 1)).alias("r"))


def memory_estimate(samples: int, features: int, item_bytes: int = 8, copies: int = 3) -> dict:
    """GiB of a dense matrix and of its working copies; advises 4-byte numbers above 8 GiB."""
    one = samples * features * item_bytes / 1024**3
    return {"matrix_gb": one, "working_gb": one * copies, "use_float32": one * copies > 8}

"""Joins that positional code leaves implicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.matrix import nearest_feature


def align_tables(key: str, first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows present in every table (an inner join on the key)."""
    for other in others:
        first = first.join(other, key)
    return first


def map_labels(df: DataFrame, mapping: DataFrame, key: str, label: str, missing: str = "unknown") -> DataFrame:
    """``label`` of ``mapping`` (key, label) for each row; rows without one get ``missing``."""
    return df.join(mapping.select(key, label), key, "left").withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit(missing)))


def window_rows(long: DataFrame, axis: DataFrame, targets: DataFrame, width: float) -> DataFrame:
    """Long rows whose coordinate lies within ``width`` of a target (target, coord, value).

    The range join runs on axis and targets (one row for each feature and each
    asked position); samples meet the result by equality of j.
    """
    near = targets.join(axis, (F.col("coord") >= F.col("target") - width) & (F.col("coord") <= F.col("target") + width))
    return long.join(near.select("target", "j", "coord"), "j")


def range_snr(long: DataFrame, axis: DataFrame, targets: DataFrame, width: float) -> DataFrame:
    """sample_id, target, height, noise, snr: largest value in each window against 1.4826 times the median absolute deviation there."""
    rows = window_rows(long, axis, targets, width)
    mid = rows.groupBy("sample_id", "target").agg(F.median("value").alias("mid"), F.max("value").alias("height"))
    dev = rows.join(mid, ["sample_id", "target"]).groupBy("sample_id", "target").agg((1.4826 * F.median(F.abs(F.col("value") - F.col("mid")))).alias("noise"), F.first("height").alias("height"), F.first("mid").alias("mid"))
    return dev.select("sample_id", "target", "height", "noise", F.when(F.col("noise") > 0, (F.col("height") - F.col("mid")) / F.col("noise")).alias("snr"))


def cut_region(long: DataFrame, axis: DataFrame, first: float, second: float) -> DataFrame:
    """Long form without the features from nearest(first) to nearest(second); positions are numbered anew. An interval given the other way round removes nothing."""
    spark, first, second = long.sparkSession, float(first), float(second)
    at = {r["target"]: r["j"] for r in nearest_feature(axis, spark.createDataFrame([(first,), (second,)], "target double")).collect()}
    low, high = at[first], at[second]
    gone = max(0, high - low + 1)
    kept = long.where(~F.col("j").between(low, high)) if gone else long
    return kept.withColumn("j", F.when(F.col("j") > high, F.col("j") - gone).otherwise(F.col("j")))


def feature_fidelity(long: DataFrame, axis: DataFrame, markers: DataFrame, reference: DataFrame, least: int = 20) -> DataFrame:
    """marker, j, n, pearson_r: each marker's nearest feature against a reference table (marker, sample_id, conc) with at least ``least`` samples."""
    at = nearest_feature(axis, markers.select("target").distinct()).join(markers, "target")
    rows = long.join(at.select("marker", "j"), "j").join(reference, ["marker", "sample_id"]).where("value IS NOT NULL AND conc IS NOT NULL")
    s = rows.groupBy("marker", "j").agg(F.count("*").alias("n"), F.covar_pop("value", "conc").alias("c"), F.stddev_pop("value").alias("a"), F.stddev_pop("conc").alias("b"))
    return s.where(F.col("n") >= least).select("marker", "j", "n", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.col("a") * F.col("b"))).alias("pearson_r"))


def islands(df: DataFrame, keys: list[str], position: str, gap: float) -> DataFrame:
    """Rows with ``island``: a new one where the step from the row before exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy(position)
    fresh = F.when(F.col(position) - F.lag(position).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_f", fresh).withColumn("island", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of each key joined to one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_f", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def trapezoid_area(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area under y over x of each key."""
    w = Window.partitionBy(*keys).orderBy(x)
    piece = (F.col(y) + F.lead(y).over(w)) / 2 * (F.lead(x).over(w) - F.col(x))
    return df.withColumn("_a", piece).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))

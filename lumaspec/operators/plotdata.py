"""Tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import dist


def cumulative_importance(df: DataFrame, key: str, value: str, share: float = 0.9) -> DataFrame:
    """key, rn, cum, needed: rank by importance, cumulative share, and how many features reach ``share`` (all if none does).

    One row for each feature.
    """
    w = Window.orderBy(F.desc(value), F.col(key))
    rows = df.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("cum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy(F.lit(0))))
    every = Window.partitionBy(F.lit(0))
    needed = F.coalesce(F.min(F.when(F.col("cum") >= share, F.col("rn"))).over(every), F.max("rn").over(every))
    return rows.withColumn("needed", needed).select(key, "rn", "cum", "needed")


def top_by_magnitude(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n rows of largest |value|, ties to the smaller key."""
    return df.orderBy(F.desc(F.abs(value)), F.col(key)).limit(n)


def loading_top(df: DataFrame, key: str, x: str, y: str, n: int) -> DataFrame:
    """The n rows of largest Euclidean length of (x, y)."""
    return df.withColumn("magnitude", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))).orderBy(F.desc("magnitude"), F.col(key)).limit(n)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), n over equal bins from the least to the largest value; the last bin is closed."""
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.floor((F.col("v") - F.col("low")) / width)).otherwise(F.lit(0))
    return v.join(F.broadcast(ends), how="cross").groupBy(F.least(F.lit(bins - 1), place.cast("int")).alias("bin")).agg(F.count("*").alias("n"))


def qq_points(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, rank, value and normal quantile of (rank - 0.5) / n within each key."""
    w = Window.partitionBy(key)
    rows = df.where(F.col(value).isNotNull()).select(key, value, F.row_number().over(w.orderBy(value)).alias("rank"), F.count("*").over(w).alias("n"))

    @F.pandas_udf(DoubleType())
    def quantile(p):
        import pandas as pd

        return pd.Series(dist.normal_quantile(p.to_numpy()))

    return rows.select(key, "rank", value, quantile((F.col("rank") - 0.5) / F.col("n")).alias("quantile"))


def stacked(matrix: DataFrame, gap: float = 1.1) -> DataFrame:
    """sample_id, offset: one step of ``gap`` times the largest magnitude for each sample, in order of id.

    Ranks are taken over ids of samples, one row each.
    """
    top = matrix.agg(F.max(F.array_max(F.transform("values", lambda v: F.abs(v)))).alias("top"))
    rows = matrix.select("sample_id").withColumn("_n", F.row_number().over(Window.orderBy("sample_id")) - 1)
    return rows.join(F.broadcast(top), how="cross").select("sample_id", (F.col("_n") * F.col("top") * gap).alias("offset"))

"""Feature moments kept up to date over a stream of samples.

An extension: the state (n, mean, m2) of each feature is what a scaler fitted in
parts needs, and states merge exactly. Each batch writes a new version of the
state; the newest whole one counts, so a repeated or broken batch does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalise import merge_moments
from ..plans.matrix import to_long

SCHEMA = "j long, n long, mean double, m2 double"


def batch_moments(matrix: DataFrame) -> DataFrame:
    """j, n, mean, m2 of a batch in array form."""
    return to_long(matrix).where("value IS NOT NULL").groupBy("j").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of whole versions, through Spark's file system so that any store works."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def current_moments(spark: SparkSession, path: str) -> DataFrame:
    known = _versions(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/v{known[-1]}") if known else spark.createDataFrame([], SCHEMA)


def update_moments(matrix: DataFrame, path: str, version: int | None = None) -> None:
    """Adds a batch. With ``version`` (a stream's batch id) a batch that is already in is left out."""
    spark = matrix.sparkSession
    known = _versions(spark, path)
    number = (known[-1] + 1 if known else 0) if version is None else version
    if number in known:
        return
    new = merge_moments(current_moments(spark, path), batch_moments(matrix)).select("j", F.col("n").cast("long").alias("n"), "mean", "m2")
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/v{number}")  # one row for each feature


def stream_moments(samples: DataFrame, path: str, checkpoint: str):
    """Starts the update over a stream in array form."""
    return samples.writeStream.foreachBatch(lambda df, i: update_moments(df, path, int(i))).option("checkpointLocation", checkpoint).start()


def windowed_stats(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and deviation of each group and window of a stream; rows later than ``late`` are dropped."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "mean", "sd")

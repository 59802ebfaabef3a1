"""Layouts of a sample matrix.

* array form: one row for each sample, ``sample_id, grp, values array<double>``;
  operators on one spectrum need no shuffle in it.
* long form: ``sample_id, grp, j, value``; operators on features are one
  aggregation in it, combined before the shuffle.
* tidy form: named numeric columns, unpivoted on use.

Features are never Spark columns of their own: plans of tens of thousands of
columns break code generation. NaN becomes NULL on entry, so aggregates skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def from_arrays(df: DataFrame, sample: str, values: str, group: str | None = None) -> DataFrame:
    """Array form of a table with an array column."""
    grp = F.col(group) if group else F.lit(None).cast("string")
    clean = F.transform(F.col(values), lambda x: F.when(~F.isnan(x), x.cast("double")))
    return df.select(F.col(sample).alias("sample_id"), grp.alias("grp"), clean.alias("values"))


def to_long(matrix: DataFrame, *carry: Column) -> DataFrame:
    """Long form of the array form; ``carry`` are more columns of each row."""
    exploded = matrix.select("sample_id", "grp", *carry, F.posexplode("values").alias("j", "value"))
    return exploded.withColumn("j", F.col("j").cast("long"))


def to_arrays(long: DataFrame) -> DataFrame:
    """Array form of the long form; the features of a sample must fit one row."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("j", "value"))), lambda s: s["value"])
    return long.groupBy("sample_id", "grp").agg(ordered.alias("values"))


def numeric_columns(df: DataFrame, leave: list[str], chosen: list[str] | None = None) -> list[str]:
    """Given columns, or all numeric ones but ``leave``; an unknown or other column is an error."""
    kinds = {f.name: f.dataType for f in df.schema}
    if chosen is not None:
        wrong = [c for c in chosen if not isinstance(kinds.get(c), NumericType)]
        if wrong:
            raise ValueError(f"not numeric columns: {wrong}")
        return list(chosen)
    return [c for c, k in kinds.items() if c not in leave and isinstance(k, NumericType)]


def tidy_to_long(df: DataFrame, group: str, value_cols: list[str] | None = None) -> DataFrame:
    """``grp, feature, value`` of numeric columns; NULL and NaN rows are left out."""
    cols = numeric_columns(df, [group], value_cols)
    wide = df.select(F.col(group).alias("grp"), *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(["grp"], cols, "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that read it more than once and join by its doubles: an aggregate computed again adds up in another order and has other last digits.

    A checkpoint in the folder of ``spark.checkpoint.dir``; where no folder is named, persisted.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            return df.persist()
        sc.setCheckpointDir(at)
    return df.checkpoint()


def nearest_feature(axis: DataFrame, targets: DataFrame) -> DataFrame:
    """For each row of ``targets`` (target): the ``j`` of the nearest ``coord``, the least of equals.

    ``targets`` are a few positions asked for; the axis has one row for each
    feature, so the pairs are bounded by both and no sample is touched.
    """
    pairs = targets.join(axis.select("j", "coord"), how="cross")
    near = F.min_by(F.struct("j", "coord"), F.struct(F.abs(F.col("coord") - F.col("target")), F.col("j")))
    return pairs.groupBy("target").agg(near.alias("at")).select("target", F.col("at.j").alias("j"), F.col("at.coord").alias("coord"))

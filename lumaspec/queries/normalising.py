"""Scaling and normalisation over ``embeddings``; positive intensities are exp(x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalise as n
from ..plans.matrix import to_long
from . import query
from .columns import LONG, long, matrix, r6

POSITIVE = f"(SELECT sample_id, grp, j, exp(value) AS value FROM {LONG} e)"


def positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir).withColumn("value", F.exp("value"))


def out(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "j", *r6("value"))


def sql(value: str, source: str = LONG) -> str:
    return f"SELECT sample_id, j, round({value}, 6) + 0.0 AS value FROM {source} l"


_J = "OVER (PARTITION BY j)"


@query(sql(f"(value - avg(value) {_J}) / stddev_pop(value) {_J}"))
def scale_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.scale(long(spark, sf_dir), "uv"))


@query(sql(f"(value - avg(value) {_J}) / sqrt(stddev_pop(value) {_J})"))
def scale_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.scale(long(spark, sf_dir), "pareto"))


@query(sql(f"value - avg(value) {_J}"))
def scale_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.scale(long(spark, sf_dir), "mean"))


@query(sql(f"(value - min(value) {_J}) / (max(value) {_J} - min(value) {_J})"))
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.scale(long(spark, sf_dir), "minmax"))


@query(sql("value"))
def scale_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.colstats import column_stats

    x = long(spark, sf_dir)
    return out(n.unscale(n.scale(x, "uv"), column_stats(x), "uv"))


def _pqn_sql(where: str) -> str:
    return f"""WITH l AS {POSITIVE}, r AS (SELECT j, median(value) AS ref FROM l {where} GROUP BY j),
q AS (SELECT sample_id, median(value / ref) AS q FROM l JOIN r USING (j) GROUP BY sample_id)
SELECT sample_id, j, round(value / q, 6) AS value FROM l JOIN q USING (sample_id)"""


@query(_pqn_sql(""))
def pqn_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.pqn(positive(spark, sf_dir)))


@query(_pqn_sql("WHERE grp = 0"))
def pqn_b_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.pqn(positive(spark, sf_dir), F.col("grp") == 0, "zero"))


@query(sql(f"(value - avg(value) {_J}) / stddev_pop(value) {_J}", POSITIVE))
def snv_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.zscore(positive(spark, sf_dir)))


_S = "OVER (PARTITION BY sample_id)"


@query(sql(f"(value - avg(value) {_S}) / stddev_pop(value) {_S}"))
def snv_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(to_long(n.snv_rows(matrix(spark, sf_dir))))


def _msc_sql(start: str) -> str:
    return f"""WITH a AS ({start}), b AS (SELECT sample_id, j, value - avg(value) {_J} AS value FROM a),
c AS (SELECT sample_id, j, value / stddev_pop(value) {_S} AS value FROM b)
SELECT sample_id, j, round(value - avg(value) {_J}, 6) + 0.0 AS value FROM c"""


@query(_msc_sql(f"SELECT sample_id, j, value FROM {POSITIVE} l"))
def msc_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.msc(positive(spark, sf_dir)))


@query(_msc_sql(f"SELECT sample_id, j, (value - avg(value) {_J}) / stddev_pop(value) {_J} AS value FROM {POSITIVE} l"))
def snv_msc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.msc(n.zscore(positive(spark, sf_dir))))


SNV_PQN = f"SELECT sample_id, j, (value - avg(value) {_S}) / median(value) {_S} AS value FROM {POSITIVE} l"


@query(f"SELECT sample_id, j, round(value, 6) + 0.0 AS value FROM ({SNV_PQN})")
def snv_pqn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.snv_pqn(positive(spark, sf_dir)))


@query(f"SELECT sample_id, j, round(value - avg(value) {_J}, 6) + 0.0 AS value FROM ({SNV_PQN})")
def snv_msc_pqn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.snv_pqn(positive(spark, sf_dir), centre=True))


@query(sql(f"(value - avg(value) {_J}) / stddev_pop(value) {_J}"))
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.zscore(long(spark, sf_dir)))


@query(sql(f"value / sum(value) {_J} * 100", POSITIVE))
def pct100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.percent_of_total(positive(spark, sf_dir)))


@query(sql(f"value / stddev_samp(value) {_J}"))
def sdnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.divide_by_sd(long(spark, sf_dir)))


@query(sql("greatest(-0.1, least(0.1, value))"))
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(long(spark, sf_dir).withColumn("value", n.clip(F.col("value"), -0.1, 0.1)))


@query(f"SELECT sample_id, j, round_even(value, 3) + 0.0 AS value FROM {LONG} l")
def round_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir).select("sample_id", "j", (F.bround("value", 3) + F.lit(0.0)).alias("value"))


@query(sql(f"(value - avg(value) {_J}) / stddev_samp(value) {_J}"))
def heatmap_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(n.row_scale(long(spark, sf_dir)))


HOLES = f"(SELECT sample_id, grp, j, CASE WHEN (sample_id * 7 + j * 13) % 97 <> 0 THEN value END AS value FROM {LONG} e)"


@query(f"""WITH l AS {HOLES}, d AS (SELECT a.sample_id, b.sample_id AS donor, sqrt(64.0 / count(*) * sum((a.value - b.value) ** 2)) AS d FROM l a JOIN l b ON a.j = b.j AND a.sample_id <> b.sample_id AND a.value IS NOT NULL AND b.value IS NOT NULL
WHERE a.sample_id IN (SELECT sample_id FROM l WHERE value IS NULL) GROUP BY ALL),
o AS (SELECT h.sample_id, h.j, b.value, row_number() OVER (PARTITION BY h.sample_id, h.j ORDER BY d.d, d.donor) AS r FROM l h JOIN d USING (sample_id) JOIN l b ON b.sample_id = d.donor AND b.j = h.j AND b.value IS NOT NULL WHERE h.value IS NULL),
f AS (SELECT sample_id, j, avg(value) AS fill FROM o WHERE r <= 2 GROUP BY ALL)
SELECT l.sample_id, l.j, round(coalesce(l.value, f.fill), 6) + 0.0 AS value FROM l LEFT JOIN f ON f.sample_id = l.sample_id AND f.j = l.j""")
def knn_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = long(spark, sf_dir).withColumn("value", F.when((F.col("sample_id") * 7 + F.col("j") * 13) % 97 != 0, F.col("value")))
    return out(n.knn_impute(x))


"""Feature statistics, correlation and plot tables over ``embeddings`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import colstats as c
from ..plans.matrix import from_arrays, to_long
from . import query
from .sqlmath import t_p

#: Long form of embeddings in SQL.
LONG = "(SELECT vec_id AS sample_id, label AS grp, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(matrix(spark, sf_dir))


def r6(*names: str):
    """Columns rounded to 6 digits, without a negative zero."""
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query(f"SELECT j, count(*) AS n, {sql6('mean', 'var', 'std0', 'low', 'high', 'total').replace('round(', 'round(any_value(').replace(', 6)', '), 6)')} FROM (SELECT j, avg(value) OVER w AS mean, var_samp(value) OVER w AS var, stddev_pop(value) OVER w AS std0, min(value) OVER w AS low, max(value) OVER w AS high, sum(value) OVER w AS total FROM {LONG} l WINDOW w AS (PARTITION BY j)) GROUP BY j")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.column_stats(long(spark, sf_dir)).select("j", "n", *r6("mean", "var", "std0", "low", "high", "total"))


@query(f"SELECT j, round(var_samp(value), 8) AS var FROM {LONG} l GROUP BY j")
def column_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.column_stats(long(spark, sf_dir)).select("j", F.round("var", 8).alias("var"))


@query(f"WITH s AS (SELECT j, var_samp(value) AS score FROM {LONG} l GROUP BY j) SELECT j, round(score, 8) AS score FROM s WHERE score >= (SELECT quantile_cont(score, 0.2) FROM s)")
def feature_preselect_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.feature_preselection(long(spark, sf_dir)).select("j", F.round("score", 8).alias("score"))


@query(f"WITH s AS (SELECT j, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS score FROM {LONG} l GROUP BY j) SELECT j, round(score, 8) AS score FROM s WHERE score >= (SELECT quantile_cont(score, 0.5) FROM s)")
def feature_preselect_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.feature_preselection(long(spark, sf_dir), 50, "iqr").select("j", F.round("score", 8).alias("score"))


STOCSY_SQL = f"""
WITH a AS (SELECT l.j, l.value, CAST(e.embedding[6] AS DOUBLE) AS anchor FROM {LONG} l JOIN embeddings e ON e.vec_id = l.sample_id),
s AS (SELECT j, count(*) AS n, covar_pop(value, anchor) / (stddev_pop(value) * stddev_pop(anchor)) AS r FROM a GROUP BY j)
SELECT j, n, round(least(1.0, greatest(-1.0, r)), 6) + 0.0 AS r,
       round(CASE WHEN j <> 5 THEN r * sqrt((n - 2) / (1 - r * r)) END, 4) + 0.0 AS t FROM s
"""


@query(STOCSY_SQL)
def stocsy_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = c.anchor_correlation(matrix(spark, sf_dir), 5)
    t = F.when(F.col("j") != 5, F.round("t", 4) + F.lit(0.0))
    return got.select("j", "n", *r6("r"), t.alias("t"))


@query(f"""SELECT j, round(r, 6) + 0.0 AS r, CASE WHEN j = 5 THEN 0.0 ELSE round({t_p('t', 'df')}, 8) END AS p_value FROM (SELECT *, n - 2 AS df, CASE WHEN j = 5 THEN 0 ELSE r * sqrt((n - 2) / (1 - r * r)) END AS t FROM
(SELECT a.j, count(*) AS n, corr(a.value, b.value) AS r FROM {LONG} a JOIN {LONG} b ON a.sample_id = b.sample_id AND b.j = 5 GROUP BY a.j))""")
def stocsy_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with its p-value; the anchor's own row has p = 0."""
    from ..operators.hypotheses import stocsy

    return stocsy(matrix(spark, sf_dir), 5).select("j", *r6("r"), F.when(F.col("j") == 5, 0.0).otherwise(F.round("p_value", 8)).alias("p_value"))


CORR_SQL = f"""
WITH l AS {LONG}, top AS (SELECT j FROM l GROUP BY j ORDER BY var_samp(value) DESC, j LIMIT 10)
SELECT a.j AS j1, b.j AS j2, round(corr(a.value, b.value), 6) + 0.0 AS r
FROM l a JOIN l b ON a.sample_id = b.sample_id AND a.j < b.j
WHERE a.j IN (SELECT j FROM top) AND b.j IN (SELECT j FROM top) GROUP BY ALL
"""


@query(CORR_SQL)
def corr_matrix_topvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    top = [r["j"] for r in c.top_variance(to_long(m), 10).collect()]
    return c.correlation_matrix(m, top).select("j1", "j2", *r6("r"))


SPEARMAN_SQL = f"""
WITH l AS {LONG}, top AS (SELECT j FROM l GROUP BY j ORDER BY var_samp(value) DESC, j LIMIT 8),
r AS (SELECT sample_id, j, rank() OVER (PARTITION BY j ORDER BY value) + (count(*) OVER (PARTITION BY j, value) - 1) / 2.0 AS value FROM l WHERE j IN (SELECT j FROM top))
SELECT a.j AS j1, b.j AS j2, round(corr(a.value, b.value), 6) + 0.0 AS r FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.j < b.j GROUP BY ALL
"""


@query(SPEARMAN_SQL)
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.matrix import to_arrays

    l = long(spark, sf_dir)  # noqa: E741
    top = sorted(r["j"] for r in c.top_variance(l, 8).collect())
    ranked = to_arrays(c.rank_transform(l.where(F.col("j").isin(top))))
    got = c.correlation_matrix(ranked, list(range(len(top))))
    names = F.array(*[F.lit(j).cast("long") for j in top])
    return got.select(F.get(names, F.col("j1").cast("int")).alias("j1"), F.get(names, F.col("j2").cast("int")).alias("j2"), *r6("r"))


SAMPLE_SQL = f"""
WITH l AS {LONG}, z AS (SELECT sample_id, j, value - avg(value) OVER (PARTITION BY sample_id) AS c FROM l),
u AS (SELECT sample_id, j, c / sqrt(sum(c * c) OVER (PARTITION BY sample_id)) AS v FROM z),
t AS (SELECT j, sum(v) AS total FROM u GROUP BY j), n AS (SELECT count(*) AS n FROM embeddings)
SELECT sample_id, round((sum(v * total) - 1) / (any_value(n) - 1), 6) + 0.0 AS r FROM u JOIN t USING (j), n GROUP BY sample_id
"""


@query(SAMPLE_SQL)
def sample_corr_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mean_sample_correlation(matrix(spark, sf_dir)).select("sample_id", *r6("r"))


@query(f"SELECT j, round(median(value), 6) + 0.0 AS value FROM {LONG} l GROUP BY j")
def median_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir).groupBy("j").agg(F.median("value").alias("value")).select("j", *r6("value"))


@query(f"SELECT j, grp, round(avg(value), 6) + 0.0 AS value, round(coalesce(stddev_samp(value), 0), 6) + 0.0 AS sd FROM {LONG} l GROUP BY j, grp")
def mean_sd_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.group_profile(long(spark, sf_dir)).select("j", "grp", *r6("value", "sd"))


@query("SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS bucket, round(avg(value), 6) AS centre, round(stddev_samp(value) / sqrt(count(value)), 6) AS spread, count(value) AS n FROM events GROUP BY ALL")
def trajectory_mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("bucket", F.trunc("ts", "month"))
    return c.trajectory(e, "event_type", "bucket", "value").select("event_type", "bucket", *r6("centre", "spread"), "n")


@query("""SELECT event_type, count(value) AS n, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high,
round(quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) AS whisker_low, round(quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) AS whisker_high FROM events GROUP BY event_type""")
def group_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.box_stats(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", *r6("low", "q1", "median", "q3", "high", "whisker_low", "whisker_high"))


@query("""WITH s AS (SELECT label, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) GROUP BY label),
h AS (SELECT *, sqrt(((a - b) / 2) ** 2 + c ** 2) AS half FROM s)
SELECT label, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(1.96 * sqrt((a + b) / 2 + half), 6) AS major, round(1.96 * sqrt(greatest((a + b) / 2 - half, 0)), 6) AS minor, round(0.5 * atan2(2 * c, a - b), 6) + 0.0 AS angle FROM h""")
def covariance_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return c.covariance_ellipse(e, "label", "x", "y").select("label", *r6("cx", "cy", "major", "minor", "angle"))


@query(f"""WITH v AS (SELECT j, var_samp(value) AS var FROM {LONG} l GROUP BY j),
s AS (SELECT j, var, row_number() OVER (ORDER BY var DESC, j) AS rn, sum(var) OVER (ORDER BY var DESC, j ROWS UNBOUNDED PRECEDING) / sum(var) OVER () AS cum FROM v)
SELECT j, rn, round(cum, 6) AS cum, least((SELECT min(rn) FROM s WHERE cum >= 0.9), (SELECT max(rn) FROM s)) AS needed FROM s""")
def cumulative_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.plotdata import cumulative_importance as cumulative

    v = long(spark, sf_dir).groupBy("j").agg(F.var_samp("value").alias("importance"))
    return cumulative(v, "j", "importance").select("j", "rn", *r6("cum"), "needed")


@query("""WITH q AS (SELECT min(x) AS low, max(x) AS high FROM (SELECT CAST(value AS DOUBLE) AS x FROM events))
SELECT least(19, CAST(floor((e.value - low) / ((high - low) / 20)) AS INTEGER)) AS bin, count(*) AS n FROM events e, q GROUP BY 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.plotdata import histogram as hist

    return hist(table(spark, sf_dir, "events"), "value", 20)

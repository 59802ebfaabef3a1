"""Latent-variable models over ``embeddings``, labels as classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latent as m
from ..plans.matrix import to_long
from . import query
from .columns import LONG, matrix, r6

TWO = f"(SELECT sample_id, j, value, CAST(grp AS DOUBLE) AS y FROM {LONG} e WHERE grp IN (0, 1))"
WEIGHTS = f"""(SELECT j, c / sqrt(sum(c * c) OVER ()) AS w FROM (SELECT j, covar_pop(value, y) * count(*) AS c FROM {TWO} l GROUP BY j))"""


def two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of two classes."""
    return matrix(spark, sf_dir).where(F.col("grp").isin(0, 1))


@query(f"SELECT j, round(w, 6) + 0.0 AS w FROM {WEIGHTS} w")
def pls1_first_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.first_pls_component(two(spark, sf_dir), F.col("grp")).select("j", *r6("w"))


@query(f"""WITH l AS {TWO}, c AS (SELECT sample_id, j, value - avg(value) OVER (PARTITION BY j) AS x FROM l), w AS {WEIGHTS},
t AS (SELECT sample_id, sum(x * w) AS t FROM c JOIN w USING (j) GROUP BY sample_id)
SELECT j, round(sum(t * x) / sum(t * t), 6) + 0.0 AS cov, round(sum(t * x) / sqrt(sum(t * t) * sum(x * x)), 6) + 0.0 AS corr FROM c JOIN t USING (sample_id) GROUP BY j""")
def splot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.normalise import centre_features

    x = two(spark, sf_dir)
    w = m.first_pls_component(x, F.col("grp"))
    centred = centre_features(to_long(x))
    t = centred.join(w, "j").groupBy("sample_id").agg(F.sum(F.col("value") * F.col("w")).alias("t"))
    return m.s_plot(centred, t).select("j", *r6("cov", "corr"))


@query(f"SELECT j, round(8 * abs(w), 5) + 0.0 AS vip FROM {WEIGHTS} w")
def vip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component: the importance is |w| times the root of the number of features."""
    model = m.pls(two(spark, sf_dir), F.col("grp"), 1, "mean")
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate(model.vip)], "j long, vip double").select("j", F.round("vip", 5).alias("vip"))


@query(f"SELECT sample_id, CAST(floor((row_number() OVER (PARTITION BY grp ORDER BY sample_id) - 1) / ceil(count(*) OVER (PARTITION BY grp) / 7.0)) AS INTEGER) AS fold FROM (SELECT DISTINCT sample_id, grp FROM {LONG} l WHERE grp IN (0, 1))")
def opls_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validation import contiguous_folds

    return contiguous_folds(two(spark, sf_dir).select("sample_id", "grp"), "sample_id", "grp", 7).select("sample_id", "fold")


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = matrix(spark, sf_dir)
    return m.pca(x, 3).scores(x)


@query()
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pca(matrix(spark, sf_dir), 5).explained(spark)


@query()
def hotelling_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = matrix(spark, sf_dir)
    return m.pca(x, 5).hotelling(x)


@query()
def opls_da(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.opls_da(two(spark, sf_dir), 3)


@query()
def lda_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.lda(matrix(spark, sf_dir), 2)[0]


@query()
def ica_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ica(matrix(spark, sf_dir), 2)


@query()
def hca_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster for each sample."""
    ids, _, flat = m.hca_samples(matrix(spark, sf_dir), 3)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, flat, strict=True)], "sample_id long, cluster int")


@query()
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.permutation_test(two(spark, sf_dir), 50)

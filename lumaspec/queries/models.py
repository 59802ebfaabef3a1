"""Two-component PLS and one-component OPLS of the two first classes of ``embeddings``, their closed forms in SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latent as m
from ..operators import wide
from . import query
from .columns import r6
from .latent import TWO, two

#: Centred features and response; then each component's weights, scores and loadings; ``d`` is what is left of the features.
PLS = f"""l AS {TWO}, x AS (SELECT sample_id, j, value - avg(value) OVER (PARTITION BY j) AS x, y - avg(y) OVER (PARTITION BY j) AS y FROM l),
w1 AS (SELECT j, c / sqrt(sum(c * c) OVER ()) AS w FROM (SELECT j, sum(x * y) AS c FROM x GROUP BY j)),
t1 AS (SELECT sample_id, sum(x * w) AS t, any_value(y) AS y FROM x JOIN w1 USING (j) GROUP BY sample_id),
s1 AS (SELECT sum(t * t) AS tt, sum(t * y) / sum(t * t) AS q, sum(y * y) AS yy FROM t1),
p1 AS (SELECT j, sum(x * t) / any_value(tt) AS p FROM x JOIN t1 USING (sample_id), s1 GROUP BY j),
d AS (SELECT sample_id, j, x - t * p AS x, x.y FROM x JOIN t1 USING (sample_id) JOIN p1 USING (j)),
w2 AS (SELECT j, c / sqrt(sum(c * c) OVER ()) AS w FROM (SELECT j, sum(x * y) AS c FROM d GROUP BY j)),
t2 AS (SELECT sample_id, sum(x * w) AS t, any_value(y) AS y FROM d JOIN w2 USING (j) GROUP BY sample_id),
s2 AS (SELECT sum(t * t) AS tt, sum(t * y) / sum(t * t) AS q FROM t2),
p2 AS (SELECT j, sum(x * t) / any_value(tt) AS p FROM d JOIN t2 USING (sample_id), s2 GROUP BY j)"""


def y(c: str = "grp"):
    return F.col(c)


@query(f"WITH {PLS} SELECT w1.j, round(sqrt(64 * (w1.w ** 2 * s1.q ** 2 * s1.tt + w2.w ** 2 * s2.q ** 2 * s2.tt) / (s1.q ** 2 * s1.tt + s2.q ** 2 * s2.tt)), 6) AS vip FROM w1 JOIN w2 USING (j), s1, s2")
def vip_two_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.pls(two(spark, sf_dir), y(), 2, "mean").features.select("j", F.round("vip", 6).alias("vip"))


@query(f"WITH {PLS} SELECT j, round(w1.w, 6) + 0.0 AS w1, round(w2.w, 6) + 0.0 AS w2, round(p1.p, 6) + 0.0 AS p1, round(p2.p, 6) + 0.0 AS p2 FROM w1 JOIN w2 USING (j) JOIN p1 USING (j) JOIN p2 USING (j)")
def pls_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.pls(two(spark, sf_dir), y(), 2, "mean").features.select("j", *r6("w1", "w2", "p1", "p2"))


@query(f"WITH {PLS} SELECT sample_id, round(t1.t, 6) + 0.0 AS t1, round(t2.t, 6) + 0.0 AS t2 FROM t1 JOIN t2 USING (sample_id)")
def pls_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.pls(two(spark, sf_dir), y(), 2, "mean").scores.select("sample_id", *r6("t1", "t2"))


PREDICTED = f"WITH {PLS} SELECT sample_id, round((SELECT avg(y) FROM (SELECT DISTINCT sample_id, y FROM l)) + s1.q * t1.t + s2.q * t2.t, 6) + 0.0 AS predicted FROM t1 JOIN t2 USING (sample_id), s1, s2"


@query(PREDICTED)
def pls_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the cross products of features."""
    x = two(spark, sf_dir)
    return m.pls(x, y(), 2, "mean").predict(x).select("sample_id", *r6("predicted"))


@query(PREDICTED)
def pls_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the cross products of samples."""
    return wide.pls(two(spark, sf_dir), y(), 2, "mean").fitted.select("sample_id", *r6("predicted"))


@query(f"""WITH {PLS} SELECT round((s1.tt * (SELECT sum(p * p) FROM p1) + s2.tt * (SELECT sum(p * p) FROM p2)) / (SELECT sum(x * x) FROM x), 6) AS r2x, round((s1.q ** 2 * s1.tt + s2.q ** 2 * s2.tt) / s1.yy, 6) AS r2y FROM s1, s2""")
def pls_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = wide.pls(two(spark, sf_dir), y(), 2, "mean")
    return spark.createDataFrame([(model.r2x, model.r2y)], "r2x double, r2y double").select(*r6("r2x", "r2y"))


@query(f"""WITH {PLS} SELECT round(1 - sum((y - s1.q * t1.t - s2.q * t2.t) ** 2) / sum(y * y), 6) AS r2, round(sqrt(avg((y - s1.q * t1.t - s2.q * t2.t) ** 2)), 6) AS rmse FROM (SELECT sample_id, t, y FROM t1) t1 JOIN (SELECT sample_id, t FROM t2) t2 USING (sample_id), s1, s2""")
def pls_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(wide.pls_quality(two(spark, sf_dir), y(), 2, "mean")).select(*r6("r2", "rmse"))


#: One orthogonal component: predictive weight, its scores, orthogonal weight, scores and loading, corrected scores.
OPLS = f"""l AS {TWO}, x AS (SELECT sample_id, j, value - avg(value) OVER (PARTITION BY j) AS x, y - avg(y) OVER (PARTITION BY j) AS y FROM l),
w AS (SELECT j, c / sqrt(sum(c * c) OVER ()) AS w FROM (SELECT j, sum(x * y) AS c FROM x GROUP BY j)),
t0 AS (SELECT sample_id, sum(x * w) AS t FROM x JOIN w USING (j) GROUP BY sample_id),
p0 AS (SELECT j, sum(x * t) / (SELECT sum(t * t) FROM t0) AS p FROM x JOIN t0 USING (sample_id) GROUP BY j),
o AS (SELECT j, o / sqrt(sum(o * o) OVER ()) AS o FROM (SELECT j, p - (SELECT sum(p * w) FROM p0 JOIN w USING (j)) * w AS o FROM p0 JOIN w USING (j))),
so AS (SELECT sample_id, sum(x * o) AS s FROM x JOIN o USING (j) GROUP BY sample_id),
po AS (SELECT j, sum(x * s) / (SELECT sum(s * s) FROM so) AS po FROM x JOIN so USING (sample_id) GROUP BY j),
t AS (SELECT sample_id, sum((x - s * po) * w) AS t, any_value(y) AS y FROM x JOIN so USING (sample_id) JOIN po USING (j) JOIN w USING (j) GROUP BY sample_id),
tt AS (SELECT sum(t * t) AS tt, sum(t * y) / sum(t * t) AS c FROM t),
p AS (SELECT j, sum(x * t) / any_value(tt) AS p, sum(x * t) / sqrt(any_value(tt) * sum(x * x)) AS corr FROM x JOIN t USING (sample_id), tt GROUP BY j)"""


@query(f"WITH {OPLS} SELECT sample_id, round(t, 6) + 0.0 AS t_pred, round(s, 6) + 0.0 AS t_ortho1 FROM t JOIN so USING (sample_id)")
def opls_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.opls(two(spark, sf_dir), y(), 1, "mean").scores.select("sample_id", *r6("t_pred", "t_ortho1"))


@query(f"WITH {OPLS} SELECT j, round(w, 6) + 0.0 AS w, round(p, 6) + 0.0 AS p, round(po, 6) + 0.0 AS po1, round(p, 6) + 0.0 AS cov, round(corr, 6) + 0.0 AS corr FROM w JOIN p USING (j) JOIN po USING (j)")
def opls_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.opls(two(spark, sf_dir), y(), 1, "mean").features.select("j", *r6("w", "p", "po1", "cov", "corr"))


@query(f"""WITH {OPLS} SELECT round(1 - (SELECT sum((x - s * po - t * p) ** 2) FROM x JOIN so USING (sample_id) JOIN po USING (j) JOIN t USING (sample_id) JOIN p USING (j)) / (SELECT sum(x * x) FROM x), 6) AS r2x,
round(1 - (SELECT sum((y - t * c) ** 2) / sum(y * y) FROM t, tt), 6) AS r2y""")
def opls_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = wide.opls(two(spark, sf_dir), y(), 1, "mean")
    return spark.createDataFrame([(model.r2x, model.r2y)], "r2x double, r2y double").select(*r6("r2x", "r2y"))


@query(f"WITH {OPLS} SELECT sample_id, j, round(x - s * po, 6) + 0.0 AS value FROM x JOIN so USING (sample_id) JOIN po USING (j)")
def opls_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features less their orthogonal part."""
    return wide.corrected(two(spark, sf_dir), y(), 1, "mean").select("sample_id", "j", *r6("value"))


@query()
def opls_da_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.opls_da(two(spark, sf_dir), 2, 3).summary


def _pairs_sql() -> str:
    """One orthogonal component for each pair of three classes."""
    parts = []
    for a, b in ((0, 1), (0, 2), (1, 2)):
        cte = OPLS.replace(TWO, TWO.replace("grp IN (0, 1)", f"grp IN ({a}, {b})").replace("CAST(grp AS DOUBLE)", f"CASE WHEN grp = {b} THEN 1.0 ELSE 0.0 END"))
        parts.append(f"(WITH {cte} SELECT '{a}' AS group1, '{b}' AS group2, j, round(p, 6) + 0.0 AS cov, round(corr, 6) + 0.0 AS corr FROM p)")
    return " UNION ALL ".join(parts)


@query(_pairs_sql())
def lazy_opls_da(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-plot vectors of each pair of three classes."""
    from .columns import matrix

    features = wide.lazy_opls_da(matrix(spark, sf_dir).where(F.col("grp").isin(0, 1, 2)), 1, 3, "mean")[1]
    return features.select("group1", "group2", "j", *r6("cov", "corr"))


NUMBERS = ("l_quantity", "l_extendedprice")
#: Pareto scaling of two features, then the eigenvectors of a 2 x 2 matrix.
PCA = """s AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, sqrt(stddev_pop(l_quantity)) AS da, sqrt(stddev_pop(l_extendedprice)) AS db FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - ma) / da AS a, (l_extendedprice - mb) / db AS b FROM lineitem, s),
c AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab, count(*) AS n FROM z),
e AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab ** 2) AS v1, (aa + bb) / 2 - sqrt(((aa - bb) / 2) ** 2 + ab ** 2) AS v2 FROM c),
u AS (SELECT *, ab / sqrt(ab ** 2 + (v1 - aa) ** 2) AS xa, (v1 - aa) / sqrt(ab ** 2 + (v1 - aa) ** 2) AS xb FROM e),
f AS (SELECT *, CASE WHEN abs(xa) >= abs(xb) THEN sign(xa) ELSE sign(xb) END * xa AS pa, CASE WHEN abs(xa) >= abs(xb) THEN sign(xa) ELSE sign(xb) END * xb AS pb FROM u)"""


def two_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .columns import table

    rows = table(spark, sf_dir, "lineitem").withColumn("sample_id", F.struct("l_orderkey", "l_linenumber"))
    return rows.select("sample_id", F.lit(0).alias("grp"), F.array(*[F.col(c).cast("double") for c in NUMBERS]).alias("values"))


@query(f"WITH {PCA} SELECT 'PC1' AS component, round(v1 / (v1 + v2), 6) AS ratio, round(pa, 6) + 0.0 AS l_quantity, round(pb, 6) + 0.0 AS l_extendedprice FROM f")
def pca_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = m.pca(two_numbers(spark, sf_dir), 1)
    rows = [("PC1", float(model.ratios[0]), float(model.loadings[0, 0]), float(model.loadings[1, 0]))]
    return spark.createDataFrame(rows, "component string, ratio double, l_quantity double, l_extendedprice double").select("component", *r6("ratio", "l_quantity", "l_extendedprice"))


@query(f"WITH {PCA} SELECT l_orderkey, l_linenumber, round(a * pa + b * pb, 4) + 0.0 AS pc1, round((a * pa + b * pb) ** 2 / v1 + (b * pa - a * pb) ** 2 / v2, 4) + 0.0 AS t2 FROM z, f")
def pca_two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First score and Hotelling's T2 of both components."""
    x = two_numbers(spark, sf_dir)
    model = m.pca(x, 2)
    got = model.scores(x)
    t2 = sum((F.col(n) * F.col(n) / float(v) for n, v in zip(model.names, model.variances, strict=True)), F.lit(0.0))
    return got.select("sample_id.l_orderkey", "sample_id.l_linenumber", (F.round("PC1", 4) + F.lit(0.0)).alias("pc1"), (F.round(t2, 4) + F.lit(0.0)).alias("t2"))


@query(f"""WITH {PCA}, r AS (SELECT a, b, a * pa + b * pb AS t, pa, pb FROM z, f WHERE l_linenumber = 1)
SELECT round(((1 - sum((a - t * pa) ** 2) / (sum(a * a) - sum(a) ** 2 / count(*))) + (1 - sum((b - t * pb) ** 2) / (sum(b * b) - sum(b) ** 2 / count(*)))) / 2, 6) AS q2_test FROM r""")
def pca_q2_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of first lines the component of all lines gives back."""
    x = two_numbers(spark, sf_dir)
    value = m.reconstruction_r2(m.pca(x, 1), x, F.col("sample_id.l_linenumber") == 1)
    return spark.createDataFrame([(value,)], "q2_test double").select(*r6("q2_test"))


@query(f"""WITH {PLS}, w AS (SELECT w1.j, w1.w AS w1, w2.w AS w2, p1.p AS p1 FROM w1 JOIN w2 USING (j) JOIN p1 USING (j)), k AS (SELECT sum(p1 * w2) AS pw FROM w)
SELECT j, round(w1 * (s1.q - pw * s2.q) + w2 * s2.q, 6) + 0.0 AS coef FROM w, k, s1, s2""")
def pls_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In units of the features as given."""
    return m.pls(two(spark, sf_dir), y(), 2, "mean").coefficients(spark).select("j", *r6("coef"))


T9 = 2.2621571627409915  #: 0.975 quantile of t on 9 degrees (published tables: 2.262)


@query(f"SELECT j, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value) * {T9}, 6) AS half FROM (SELECT j, grp, avg(value) AS value FROM (SELECT label AS grp, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings) GROUP BY j, grp) GROUP BY j")
def jackknife_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means stand in for the loadings of ten folds."""
    from .columns import long

    folds = long(spark, sf_dir).groupBy("j", F.col("grp").alias("fold")).agg(F.avg("value").alias("value"))
    return m.jackknife(folds, 10).select("j", *r6("mean", "half"))

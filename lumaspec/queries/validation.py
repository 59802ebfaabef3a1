"""Splits, scores and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation as v
from . import query
from .columns import LONG, long, matrix, r6, table

CALLS = "(SELECT l_returnflag AS actual, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_quantity > 15 THEN 'N' ELSE 'R' END AS predicted FROM lineitem)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("actual"), F.when(q > 30, "A").when(q > 15, "N").otherwise("R").alias("predicted"), (F.col("l_returnflag") == "A").cast("int").alias("y"), F.col("l_extendedprice").alias("score"))


@query(f"""WITH c AS {CALLS}, k AS (SELECT actual AS c FROM c UNION SELECT predicted FROM c), n AS (SELECT actual, predicted, count(*) AS n FROM c GROUP BY ALL)
SELECT a.c AS actual, b.c AS predicted, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.c), 6) AS share FROM k a CROSS JOIN k b LEFT JOIN n ON n.actual = a.c AND n.predicted = b.c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.confusion(calls(spark, sf_dir), "actual", "predicted").select("actual", "predicted", "n", *r6("share"))


@query("""WITH r AS (SELECT l_returnflag = 'A' AS y, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem)
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r""")
def roc_auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.auc(calls(spark, sf_dir), "y", "score").select(*r6("auc"))


@query("""WITH g AS (SELECT l_quantity AS score, count(*) FILTER (l_returnflag = 'A') AS p, count(*) FILTER (l_returnflag <> 'A') AS n FROM lineitem GROUP BY 1)
SELECT score, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("y"), F.col("l_quantity").alias("score"))
    return v.roc(lines, "y", "score").select("score", *r6("tpr", "fpr"))


@query(f"""WITH c AS {CALLS}, n AS (SELECT actual, predicted, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT DISTINCT actual AS k FROM c),
s AS (SELECT k, sum(n) FILTER (actual = k AND predicted = k) AS tp, sum(n) FILTER (actual = k) AS a, sum(n) FILTER (predicted = k) AS b FROM k, n GROUP BY k)
SELECT round(sum(tp) / sum(a), 6) AS accuracy, round(avg(tp / a), 6) AS balanced_accuracy, round(avg(2 * tp / (a + b)), 6) AS macro_f1 FROM s""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.class_metrics(calls(spark, sf_dir), "actual", "predicted").select(*r6("accuracy", "balanced_accuracy", "macro_f1"))


@query("SELECT toxic, CAST(count(*) - floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_train, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_test FROM labels GROUP BY toxic")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = v.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "toxic")
    return v.class_balance(split, "toxic").select("toxic", "n_train", "n_test")


@query()
def fold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.folds(table(spark, sf_dir, "labels"), "doc_id", "stratified_kfold", 5, label="toxic")


@query(f"WITH g AS (SELECT exp(value) AS value, j FROM {LONG} l) SELECT round(median(abs(100 * s / m)), 6) AS median_cv FROM (SELECT j, avg(value) AS m, stddev_samp(value) AS s FROM g GROUP BY j)")
def qc_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.feature_cv(long(spark, sf_dir).withColumn("value", F.exp("value"))).select(*r6("median_cv"))


@query(f"SELECT grp, round(avg(abs(100 * s / m)), 6) AS cv FROM (SELECT grp, j, avg(exp(value)) AS m, stddev_samp(exp(value)) AS s FROM {LONG} l GROUP BY grp, j) GROUP BY grp")
def qc_replicate_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.replicate_cv(long(spark, sf_dir).withColumn("value", F.exp("value"))).select("grp", *r6("cv"))


@query(f"""WITH l AS {LONG}, p AS (SELECT a.grp, corr(a.value, b.value) AS r FROM l a JOIN l b ON a.grp = b.grp AND a.j = b.j AND a.sample_id < b.sample_id GROUP BY a.grp, a.sample_id, b.sample_id)
SELECT grp, round(avg(r), 6) + 0.0 AS r FROM p GROUP BY grp""")
def replicate_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.replicate_correlation(matrix(spark, sf_dir)).select("grp", *r6("r"))


@query(f"""WITH l AS {LONG}, d AS (SELECT sample_id, any_value(grp) AS grp, sqrt(sum(e * e)) AS d FROM (SELECT sample_id, grp, value - avg(value) OVER (PARTITION BY grp, j) AS e FROM l) GROUP BY sample_id)
SELECT grp, round(avg(d), 6) AS dispersion FROM d GROUP BY grp""")
def qc_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.dispersion(long(spark, sf_dir)).select("grp", *r6("dispersion"))


@query(f"""WITH l AS {LONG}, r AS (SELECT j, median(value) AS ref FROM l GROUP BY j)
SELECT sample_id, round(sqrt(avg((value - ref) ** 2)), 6) AS rmse, round(corr(value, ref), 6) + 0.0 AS r, round(abs(sum(value) - sum(ref)) / abs(sum(ref)), 4) AS area_error,
round(sum(CASE WHEN value < 0 THEN -value ELSE 0 END) / sum(abs(value)), 6) + 0.0 AS negative_share FROM l JOIN r USING (j) GROUP BY sample_id""")
def reference_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = long(spark, sf_dir)
    ref = x.groupBy("j").agg(F.median("value").alias("ref"))
    return v.reference_errors(x, ref).select("sample_id", *r6("rmse", "r"), F.round("area_error", 4).alias("area_error"), *r6("negative_share"))


@query(f"""WITH l AS {LONG}, a AS (SELECT j FROM l WHERE grp = 0 GROUP BY j ORDER BY var_samp(value) DESC, j LIMIT 20), b AS (SELECT j FROM l WHERE grp = 1 GROUP BY j ORDER BY var_samp(value) DESC, j LIMIT 20)
SELECT round((SELECT count(*) FROM a WHERE j IN (SELECT j FROM b)) / (SELECT count(*) FROM (SELECT j FROM a UNION SELECT j FROM b)), 6) AS jaccard""")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = long(spark, sf_dir)
    of = lambda g: x.where(F.col("grp") == g).groupBy("j").agg(F.var_samp("value").alias("score"))
    return v.top_jaccard(of(0), of(1), "j", "score", 20).select(*r6("jaccard"))


@query(f"""WITH l AS (SELECT j, grp, exp(value) AS value, CASE WHEN grp = 1 THEN 1.0 ELSE 0.0 END AS y FROM {LONG} e WHERE grp IN (0, 1))
SELECT j, round(log2(median(value) FILTER (grp = 1) / median(value) FILTER (grp = 0)), 6) + 0.0 AS log2fc, round(corr(value, y), 6) + 0.0 AS r FROM l GROUP BY j""")
def group_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.group_direction(long(spark, sf_dir).withColumn("value", F.exp("value")), 0, 1).select("j", *r6("log2fc", "r"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).withColumn("key", F.xxhash64("actual", "predicted", "score"))
    return v.bootstrap_interval(rows, "key", "actual", "predicted", 50)


@query()
def rf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ml import Classifier

    return Classifier("rf").cross_validate(matrix(spark, sf_dir), 3)

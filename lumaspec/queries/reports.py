"""Report tables and quality figures over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hypotheses as t
from ..operators import reports as r
from . import query
from .columns import LONG, long, matrix, r6, table
from .hypotheses import NUMBERS, WELCH_P, lines
from .sqlmath import bh, normal_quantile
from .validation import CALLS, calls

#: Importance and coefficient that stand in for a model's: spread of a feature, and its covariance with the label.
VIPS = f"(SELECT j, sqrt(var_pop(value)) * 2 AS vip, covar_pop(value, grp) AS coef, covar_pop(value, grp) - 0.01 AS low, covar_pop(value, grp) + 0.02 AS high FROM {LONG} l GROUP BY j)"


def vips(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("grp").cast("double")
    c = F.covar_pop("value", y)
    return long(spark, sf_dir).groupBy("j").agg((F.stddev_pop("value") * 2).alias("vip"), c.alias("coef")).select("*", (F.col("coef") - 0.01).alias("low"), (F.col("coef") + 0.02).alias("high"))


@query(f"SELECT j, round(vip, 6) AS vip FROM {VIPS} v WHERE vip >= (SELECT median(vip) FROM {VIPS} m)")
def vip_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = vips(spark, sf_dir)
    return r.vip_filter(all_, all_.agg(F.median("vip")).first()[0]).select("j", *r6("vip"))


@query(f"""SELECT j, round(vip * sign(coef), 6) + 0.0 AS signed_vip, CASE WHEN vip * sign(coef) >= 0.26 THEN 'High in 1' WHEN vip * sign(coef) <= -0.26 THEN 'High in 0' ELSE 'Under cut off' END AS direction FROM {VIPS} v""")
def signed_vips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.signed_vip(vips(spark, sf_dir), "0", "1", 0.26).select("j", *r6("signed_vip"), "direction")


@query(f"SELECT j, round(median(value) * sign(corr(value, grp)), 6) + 0.0 AS value FROM {LONG} l GROUP BY j")
def loading_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = long(spark, sf_dir)
    return r.loading_vector(x, x.groupBy("j").agg(F.corr("value", F.col("grp").cast("double")).alias("corr"))).select("j", *r6("value"))


@query(f"""SELECT feature, round(neg, 6) + 0.0 AS neg_log10_p FROM (SELECT feature, -log10(p_adj) AS neg, log2(mb / ma) AS fc, p_adj FROM {bh(WELCH_P, 'feature')} v) WHERE p_adj < 0.999 AND abs(fc) > 0.00001 ORDER BY round(neg, 9) DESC, feature LIMIT 2""")
def top_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = t.volcano(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", NUMBERS, p_limit=0.999, fc_limit=0.00001)
    return r.top_labels(got.withColumn("neg_log10_p", F.round("neg_log10_p", 9)), 2).select("feature", *r6("neg_log10_p"))


@query(f"""SELECT row_number() OVER (ORDER BY coef, j) AS rank, j, round(coef, 6) + 0.0 AS coef, round(abs(coef - low), 6) AS below, round(abs(high - coef), 6) AS above FROM (SELECT * FROM {VIPS} v ORDER BY abs(coef) DESC, j LIMIT 12)""")
def coefficient_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.coefficient_bars(vips(spark, sf_dir), 12, "signed").select("rank", "j", *r6("coef", "below", "above"))


@query("""SELECT round(least((max(l_quantity) - min(l_quantity)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), (max(l_discount) - min(l_discount)) / (SELECT (max(c_nationkey) - min(c_nationkey))::DOUBLE FROM customer)) * 0.7, 8) AS factor FROM lineitem""")
def loading_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    loadings = table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return r.loading_scale(scores, loadings).select(F.round("factor", 8).alias("factor"))


@query(f"SELECT sample_id, 63 - j AS j, round(value, 6) + 0.0 AS value FROM {LONG} l")
def flipped_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.flipped(matrix(spark, sf_dir)).select("sample_id", F.posexplode("values").alias("j", "value"))
    return rows.select("sample_id", F.col("j").cast("long").alias("j"), *r6("value"))


SHIFTS_SQL = """(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1.' || p_size::VARCHAR || '-2.5, 9' WHEN 1 THEN '0.' || p_size::VARCHAR WHEN 2 THEN 'x-1' WHEN 3 THEN '-0.5' WHEN 4 THEN ' 3.25 , 4' END AS shifts,
CASE p_partkey % 3 WHEN 0 THEN 'Sex:F|Group:' || p_brand || '|Age:3' WHEN 1 THEN 'Group: ' || p_type ELSE p_name END AS note FROM part)"""


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN round((CAST('1.' || p_size::VARCHAR AS DOUBLE) + 2.5) / 2, 6) WHEN 1 THEN CAST('0.' || p_size::VARCHAR AS DOUBLE) WHEN 3 THEN -0.5 WHEN 4 THEN 3.25 END AS shift,
nullif(trim(regexp_extract(note, 'Group:([^|]+)', 1)), '') AS tag FROM {SHIFTS_SQL} s JOIN part USING (p_partkey)""")
def shift_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    shifts = F.when(k == 0, F.concat(F.lit("1."), size, F.lit("-2.5, 9"))).when(k == 1, F.concat(F.lit("0."), size)).when(k == 2, "x-1").when(k == 3, "-0.5").when(k == 4, " 3.25 , 4")
    g = F.col("p_partkey") % 3
    note = F.when(g == 0, F.concat(F.lit("Sex:F|Group:"), "p_brand", F.lit("|Age:3"))).when(g == 1, F.concat(F.lit("Group: "), "p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(r.shift_centre(shifts), 6).alias("shift"), r.group_tag(note).alias("tag"))


@query("SELECT DISTINCT l_discount AS x FROM lineitem WHERE l_discount IS NOT NULL")
def picked_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.picked_peaks(table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x")))


@query("SELECT vec_id AS sample_id, round(CAST(embedding[4] AS DOUBLE), 6) + 0.0 AS ppm_3, round(CAST(embedding[41] AS DOUBLE), 6) + 0.0 AS ppm_40 FROM embeddings")
def picked_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.picked_intensities(matrix(spark, sf_dir), [3, 40], ["ppm_3", "ppm_40"]).select("sample_id", *r6("ppm_3", "ppm_40"))


@query(f"WITH l AS {LONG} SELECT a.sample_id AS a, b.sample_id AS b, round(corr(a.value, b.value), 6) + 0.0 AS r FROM l a JOIN l b ON a.j = b.j AND a.sample_id <= b.sample_id GROUP BY ALL")
def sample_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.sample_correlations(matrix(spark, sf_dir)).select("a", "b", *r6("r"))


@query("""WITH q AS (SELECT c_mktsegment AS grp, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
SELECT grp, any_value(n) AS n, round(any_value(q1), 4) + 0.0 AS q1, round(any_value(median), 4) + 0.0 AS median, round(any_value(q3), 4) + 0.0 AS q3,
round(min(c_acctbal) FILTER (c_acctbal >= q1 - 1.5 * (q3 - q1)), 4) + 0.0 AS low, round(max(c_acctbal) FILTER (c_acctbal <= q3 + 1.5 * (q3 - q1)), 4) + 0.0 AS high,
count(*) FILTER (c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)) AS outliers FROM customer JOIN q ON grp = c_mktsegment GROUP BY grp""")
def box_whiskers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = r.box_whiskers(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").cast("double").alias("v")), "grp", "v")
    return got.select("grp", "n", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("q1", "median", "q3", "low", "high")], "outliers")


@query("""WITH g AS (SELECT o_orderpriority AS g, min(o_orderkey) AS o FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT x.g AS group1, y.g AS group2, replace(x.g || '_vs_' || y.g, '/', '_') AS name FROM g x JOIN g y ON x.o < y.o""")
def named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.named_pairs(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query(f"""WITH c AS {CALLS}, k AS (SELECT actual, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS recall FROM c GROUP BY actual)
SELECT round((SELECT avg(recall) FROM k), 6) AS balanced_accuracy, round(avg(CASE WHEN predicted = 'R' THEN 1.0 ELSE 0.0 END) FILTER (actual = 'R'), 6) AS sensitivity,
round(avg(CASE WHEN predicted <> 'R' THEN 1.0 ELSE 0.0 END) FILTER (actual <> 'R'), 6) AS specificity FROM c""")
def class_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.class_rates(calls(spark, sf_dir), "actual", "predicted", "R").select(*r6("balanced_accuracy", "sensitivity", "specificity"))


def _spearman_sql(rows: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    also = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    return f"""SELECT {keys + ',' if keys else ''} count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS r FROM
(SELECT *, rank() OVER ({part} ORDER BY x) + (count(*) OVER ({also}x) - 1) / 2.0 AS rx, rank() OVER ({part} ORDER BY y) + (count(*) OVER ({also}y) - 1) / 2.0 AS ry FROM {rows} s) {'GROUP BY ' + keys if keys else ''}"""


@query(_spearman_sql(f"(SELECT a.j, a.v AS x, b.v AS y FROM (SELECT j, var_samp(value) AS v FROM {LONG} l WHERE grp = 0 GROUP BY j) a JOIN (SELECT j, var_samp(value) AS v FROM {LONG} m WHERE grp = 1 GROUP BY j) b USING (j))"))
def vip_rank_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank stability of two importance vectors."""
    x = long(spark, sf_dir)
    of = lambda g, c: x.where(F.col("grp") == g).groupBy("j").agg(F.var_samp("value").alias(c))
    return r.spearman(of(0, "x").join(of(1, "y"), "j").withColumn("k", F.lit(0)), ["k"], "x", "y").select("n", *r6("r"))


@query(_spearman_sql("(SELECT l_linestatus AS k, l_quantity AS x, l_tax AS y FROM lineitem)", "k"))
def marker_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation for each marker, with ties; at least 20 samples."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    return r.spearman(rows, ["k"], "x", "y", 20).select("k", "n", *r6("r"))


@query(f"""SELECT round(avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END), 8) AS negative_fraction FROM {LONG} l""")
def negative_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.spectrum_quality(long(spark, sf_dir)).select(F.round("negative_fraction", 8).alias("negative_fraction"))


@query(f"""WITH a AS (SELECT sample_id, any_value(grp) AS grp, sum(value) AS area FROM {LONG} l GROUP BY sample_id), g AS (SELECT grp, avg(area) AS ref FROM a GROUP BY grp)
SELECT round(avg(abs(area - ref) / (abs(ref) + 1e-12)), 4) AS area_error FROM a JOIN g USING (grp)""")
def area_relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = long(spark, sf_dir).groupBy("sample_id").agg(F.first("grp").alias("grp"), F.sum("value").alias("area"))
    ref = a.groupBy("grp").agg(F.avg("area").alias("ref"))
    return r.area_relative_error(a.join(ref, "grp")).select(F.round("area_error", 4).alias("area_error"))


@query(f"""WITH s AS (SELECT a.feature, a.m - b.m AS x, c.m - b.m AS y, abs(a.m - b.m) > 0.001 AS telling FROM (SELECT feature, avg(value) AS m FROM lines WHERE grp = 'A' GROUP BY feature) a
JOIN (SELECT feature, avg(value) AS m FROM lines WHERE grp = 'N' GROUP BY feature) b USING (feature) JOIN (SELECT feature, avg(value) AS m FROM lines WHERE grp = 'R' GROUP BY feature) c USING (feature))
SELECT round(avg(CASE WHEN (x > 0) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS all_rows, round(avg(CASE WHEN (x > 0) = (y > 0) THEN 1.0 ELSE 0.0 END) FILTER (telling), 6) AS telling_rows FROM s""".replace("FROM lines", "FROM (" + " UNION ALL ".join(f"SELECT l_returnflag AS grp, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in NUMBERS) + ") l"))
def direction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda g: F.avg(F.when(F.col("grp") == g, F.col("value")))
    s = lines(spark, sf_dir).groupBy("feature").agg((m("A") - m("N")).alias("x"), (m("R") - m("N")).alias("y")).withColumn("telling", F.abs("x") > 0.001)
    return r.direction_agreement(s, "x", "y", "telling").select(*r6("all_rows", "telling_rows"))


@query("SELECT n_name AS name, CASE WHEN n_regionkey > 0 THEN round(n_nationkey / n_regionkey, 6) ELSE 'inf'::DOUBLE END AS throughput, CASE WHEN n_regionkey > 0 THEN round(7.0 / n_regionkey, 6) ELSE 'inf'::DOUBLE END AS speedup FROM nation")
def run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("items"), F.col("n_regionkey").alias("seconds"), F.lit(7.0).alias("baseline_seconds"))
    return r.run_figures(runs).select("name", *[F.round(c, 6).alias(c) for c in ("throughput", "speedup")])


@query(f"SELECT round(max(abs(value - m)), 6) AS max_abs_error FROM (SELECT value, avg(value) OVER (PARTITION BY j) AS m FROM {LONG} l)")
def max_abs_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = long(spark, sf_dir)
    means = x.groupBy("j").agg(F.avg("value").alias("m"))
    return r.max_abs_error(x, x.join(means, "j").withColumn("value", F.col("m")), ["sample_id", "j"]).select(*r6("max_abs_error"))


@query(f"""SELECT c_mktsegment AS key, rank, round(value, 2) AS value, round({normal_quantile('p')}, 6) + 0.0 AS quantile FROM
(SELECT c_mktsegment, c_acctbal AS value, row_number() OVER w AS rank, (row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY c_mktsegment) AS p FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal))""")
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import plotdata

    got = plotdata.qq_points(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_acctbal").cast("double").alias("value")), "key", "value")
    return got.select("key", F.col("rank").cast("long").alias("rank"), F.round("value", 2).alias("value"), *r6("quantile"))


SCORES = "(SELECT l_returnflag AS label, l_quantity / 50 AS \"A\", l_discount * 10 AS \"N\", l_tax * 12 AS \"R\" FROM lineitem)"


@query(f"""WITH s AS (SELECT class, label = class AS y, score FROM (UNPIVOT {SCORES} ON "A", "N", "R" INTO NAME class VALUE score)),
u AS (SELECT * FROM s UNION ALL SELECT 'micro', y, score FROM s),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM u)
SELECT class, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r GROUP BY class""")
def roc_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validation import one_vs_rest_auc

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_quantity") / 50).alias("A"), (F.col("l_discount") * 10).alias("N"), (F.col("l_tax") * 12).alias("R"))
    return one_vs_rest_auc(rows, "label", ["A", "N", "R"]).select("class", *r6("auc"))

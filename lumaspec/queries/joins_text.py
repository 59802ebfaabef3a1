"""Joins, intervals and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import joins as j
from ..plans.matrix import nearest_feature
from . import query
from .columns import LONG, long, r6, table

#: 64 positions from 9.5 down to 0.5.
AXIS_SQL = "(SELECT CAST(i AS BIGINT) AS j, 9.5 - 9.0 * i / 63.0 AS coord FROM range(64) t(i))"


#: Seconds since 1970 of a time stamp without zone, whatever the session's zone.
SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0}) / 1e6"


def axis(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(s.ppm_axis(9.5, 9.0, 64)).alias("j", "coord")).select(F.col("j").cast("long").alias("j"), "coord")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1.0,), (3.03,), (5.25,), (8.4,)], "target double")


TARGETS_SQL = "(SELECT CAST(unnest([1.0, 3.03, 5.25, 8.4]) AS DOUBLE) AS target)"


@query(f"SELECT j, round(coord, 9) AS coord FROM {AXIS_SQL} a")
def ppm_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis(spark).select("j", F.round("coord", 9).alias("coord"))


@query(f"SELECT target, arg_min(j, (abs(coord - target), j)) AS j FROM {AXIS_SQL} a, {TARGETS_SQL} t GROUP BY target")
def nearest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_feature(axis(spark), targets(spark)).select("target", "j")


@query(f"""WITH r AS (SELECT sample_id, target, value FROM {LONG} l JOIN {AXIS_SQL} a USING (j) JOIN {TARGETS_SQL} t ON coord BETWEEN target - 0.5 AND target + 0.5),
m AS (SELECT sample_id, target, median(value) AS mid, max(value) AS height FROM r GROUP BY ALL),
d AS (SELECT sample_id, target, any_value(height) AS height, any_value(mid) AS mid, 1.4826 * median(abs(value - mid)) AS noise FROM r JOIN m USING (sample_id, target) GROUP BY ALL)
SELECT sample_id, target, round(height, 6) + 0.0 AS height, round(noise, 6) AS noise, round((height - mid) / noise, 4) AS snr FROM d""")
def range_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = j.range_snr(long(spark, sf_dir), axis(spark), targets(spark), 0.5)
    return got.select("sample_id", "target", *r6("height", "noise"), F.round("snr", 4).alias("snr"))


@query(f"SELECT sample_id, CASE WHEN j > 35 THEN j - 6 ELSE j END AS j, round(value, 6) + 0.0 AS value FROM {LONG} l WHERE j NOT BETWEEN 30 AND 35")
def region_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.cut_region(long(spark, sf_dir), axis(spark), 9.5 - 9 * 30 / 63, 9.5 - 9 * 35 / 63).select("sample_id", "j", *r6("value"))


@query("""WITH g AS (SELECT user_id, epoch(ts) AS x, value FROM events), f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) > 86400 THEN 1 ELSE 0 END AS f FROM g),
i AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
SELECT user_id, island, count(*) AS n, round(sum(value), 6) AS total FROM i GROUP BY ALL""")
def peak_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.expr(SECONDS.format("ts")).alias("x"), "value")
    return j.islands(e, ["user_id"], "x", 86400.0).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH w AS (SELECT user_id, epoch(ts) AS a, epoch(ts) + 43200.0 AS b FROM events),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS r FROM w),
i AS (SELECT *, sum(CASE WHEN r = 1 THEN 1 ELSE f END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, round(min(a), 3) AS a, round(max(b), 3) AS b, count(*) AS n FROM i GROUP BY user_id, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").select("user_id", F.expr(SECONDS.format("ts")).alias("a"), (F.expr(SECONDS.format("ts")) + 43200.0).alias("b"))
    return j.merge_intervals(w, ["user_id"], "a", "b").select("user_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "n")


@query(f"""WITH p AS (SELECT sample_id, value, lead(value) OVER w AS nv, coord, lead(coord) OVER w AS nc FROM {LONG} l JOIN {AXIS_SQL} a USING (j) WINDOW w AS (PARTITION BY sample_id ORDER BY coord))
SELECT sample_id, round(sum((value + nv) / 2 * (nc - coord)), 6) + 0.0 AS area FROM p GROUP BY sample_id""")
def trapz_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.trapezoid_area(long(spark, sf_dir).join(axis(spark), "j"), ["sample_id"], "coord", "value").select("sample_id", *r6("area"))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3) n ON n_nationkey = c_nationkey")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return j.map_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("SELECT d.doc_id, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def index_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.align_tables("doc_id", table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query(f"""WITH m AS (SELECT 'm' || CAST(target AS VARCHAR) AS marker, target, arg_min(j, (abs(coord - target), j)) AS j FROM {AXIS_SQL} a, {TARGETS_SQL} t GROUP BY target)
SELECT marker, m.j, count(*) AS n, round(corr(value, grp), 6) + 0.0 AS pearson_r FROM {LONG} l JOIN m USING (j) GROUP BY ALL HAVING count(*) >= 20""")
def feature_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = targets(spark).withColumn("marker", F.concat(F.lit("m"), F.col("target").cast("string")))
    x = long(spark, sf_dir)
    reference = x.where("j = 0").select("sample_id", F.col("grp").cast("double").alias("conc")).join(F.broadcast(markers.select("marker")), how="cross")  # four markers
    return j.feature_fidelity(x, axis(spark), markers, reference).select("marker", "j", "n", *r6("pearson_r"))


HTML_SQL = """replace(replace(replace(replace(replace(substr(trim({0}, ' '), 1, 256), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(f"SELECT page_id, {HTML_SQL.format('html')} AS html FROM pages")
def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", s.html_text(F.col("html")).alias("html"))


@query("SELECT doc_id, CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@', chr(9)) THEN '''' || text ELSE text END AS text FROM documents")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", s.csv_text(F.col("text")).alias("text"))


@query("SELECT vec_id, list_transform(list_concat(embedding[60:64], embedding[1:59]), lambda x: round(x::DOUBLE, 6)) AS rolled FROM embeddings")
def array_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = s.roll(F.col("embedding"), F.lit(5))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(rolled, lambda x: s.round_signed(x.cast("double"), 6)).alias("rolled"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE round(log2(p_size), 6) END AS log2_size, round(-log10(p_size / 100.0), 6) + 0.0 AS nlp,
CASE WHEN p_size / 1000.0 < 0.001 THEN '***' WHEN p_size / 1000.0 < 0.01 THEN '**' WHEN p_size / 1000.0 < 0.05 THEN '*' ELSE 'ns' END AS stars FROM part""")
def scalar_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    odd = F.when(p % 7 == 0, -p).otherwise(p)  # not positive: NULL
    return table(spark, sf_dir, "part").select("p_partkey", F.round(s.log2_positive(odd), 6).alias("log2_size"), (F.round(s.neg_log10(p / 100.0), 6) + F.lit(0.0)).alias("nlp"), s.stars(p / 1000.0).alias("stars"))


@query("""WITH g AS (SELECT user_id, list(epoch(ts) / 86400.0 ORDER BY ts, event_id) AS x, list(value ORDER BY ts, event_id) AS h FROM events WHERE value > 0 GROUP BY user_id),
d AS (SELECT user_id, len(x) AS n, h, [abs(x[i + 1] - x[i]) for i in range(1, len(x))] AS gaps FROM g),
m AS (SELECT *, list_avg(gaps) AS gm, CASE n WHEN 2 THEN [1.0, 1.0] WHEN 3 THEN [0.5, 1.0, 0.5] WHEN 4 THEN [1.0 / 3, 1.0, 1.0, 1.0 / 3] END AS ideal FROM d),
c AS (SELECT user_id, n, CASE WHEN gm > 0 THEN sqrt(list_avg([(g - gm) ** 2 for g in gaps])) / gm ELSE 1.0 END AS cv, CASE WHEN n BETWEEN 2 AND 4 THEN list_avg([abs(h[i] / list_max(h) - ideal[i]) for i in range(1, n + 1)]) END AS off FROM m)
SELECT user_id, CASE WHEN n = 1 THEN 'singlet' WHEN n BETWEEN 2 AND 4 AND cv < 0.25 AND off <= 0.35 THEN CASE n WHEN 2 THEN 'doublet' WHEN 3 THEN 'triplet' ELSE 'quartet' END ELSE 'multiplet' END AS pattern FROM c""")
def binomial_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 0").withColumn("x", F.expr(SECONDS.format("ts")) / 86400.0)
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("x", "event_id", "value"))).alias("p"))
    x, h = F.transform("p", lambda r: r["x"]), F.transform("p", lambda r: r["value"])
    return g.select("user_id", s.multiplet_pattern(x, h).alias("pattern"))

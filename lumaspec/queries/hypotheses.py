"""Group tests and corrections over ``lineitem``, ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import plotdata
from ..operators import hypotheses as t
from ..plans.matrix import tidy_to_long
from . import query
from .columns import r6, table
from .sqlmath import bh, chi2_p, f_p, normal_p, range_p, stars, t_p

NORMAL_Z, F_TAIL = normal_p("z"), f_p("f", "df1", "df2")
NUMBERS = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
LINES = "(" + " UNION ALL ".join(f"SELECT l_returnflag AS grp, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in NUMBERS) + ")"
WELCH_SQL = f"""(SELECT feature, count(*) FILTER (grp = 'A') AS na, count(*) FILTER (grp = 'R') AS nb, avg(value) FILTER (grp = 'A') AS ma, avg(value) FILTER (grp = 'R') AS mb,
var_samp(value) FILTER (grp = 'A') AS va, var_samp(value) FILTER (grp = 'R') AS vb FROM {LINES} l GROUP BY feature)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_to_long(table(spark, sf_dir, "lineitem"), "l_returnflag", NUMBERS)


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_to_long(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"])


@query(f"""SELECT feature, round(log2(mb / ma), 8) + 0.0 AS "log2FC", round((ma - mb) / sqrt(va / na + vb / nb), 6) + 0.0 AS t,
round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 2) AS df FROM {WELCH_SQL} w""")
def volcano_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = t.volcano(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", NUMBERS)
    return got.select("feature", (F.round("log2FC", 8) + F.lit(0.0)).alias("log2FC"), *r6("t"), F.round("df", 2).alias("df"))


def r8(*names: str):
    """Columns rounded to 8 digits."""
    return [F.round(n, 8).alias(n) for n in names]


WELCH_T = f"""(SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM {WELCH_SQL} w)"""
WELCH_P = f"""(SELECT *, {t_p('t', 'df')} AS p_value FROM {WELCH_T} wt)"""


@query(f"""SELECT feature, round(log2(mb / ma), 8) + 0.0 AS "log2FC", round(t, 6) + 0.0 AS t, round(p_value, 8) AS p_value, round(p_adj, 8) AS p_adj, round(-log10(p_adj), 6) + 0.0 AS neg_log10_p,
CASE WHEN p_adj < 0.9 AND log2(mb / ma) > 0.0001 THEN 'Up' WHEN p_adj < 0.9 AND log2(mb / ma) < -0.0001 THEN 'Down' ELSE 'NS' END AS label FROM {bh(WELCH_P, 'feature')} v""")
def volcano_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; limits so wide that labels differ."""
    got = t.volcano(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", NUMBERS, p_limit=0.9, fc_limit=0.0001)
    return got.select("feature", (F.round("log2FC", 8) + F.lit(0.0)).alias("log2FC"), *r6("t"), *r8("p_value", "p_adj"), *r6("neg_log10_p"), "label")


@query(f"""SELECT feature, round(fc, 8) + 0.0 AS fc, round(p_value, 8) AS p_value, CASE WHEN p_value < 0.9 AND fc >= 0.0001 THEN 'Up' WHEN p_value < 0.9 AND fc <= -0.0001 THEN 'Down' ELSE 'NS' END AS label
FROM (SELECT *, log2(mb / ma) AS fc FROM {WELCH_P} p)""")
def fold_change_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = t.fold_change(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", NUMBERS, p_limit=0.9, fc_limit=0.0001)
    return got.select("feature", (F.round("fc", 8) + F.lit(0.0)).alias("fc"), *r8("p_value"), "label")


@query(f"SELECT feature, round(log2(mb / ma), 8) + 0.0 AS fc FROM {WELCH_SQL} w ORDER BY abs(log2(mb / ma)) DESC, feature LIMIT 3")
def fold_change_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = t.fold_change(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", NUMBERS)
    return plotdata.top_by_magnitude(got, "feature", "fc", 3).select("feature", (F.round("fc", 8) + F.lit(0.0)).alias("fc"))


ORDER_SQL = "(SELECT o_orderpriority AS grp, o_totalprice AS value FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL)"
ANOVA_SQL = f"""(SELECT sum(n * (m - mm) ** 2) AS ssb, sum((n - 1) * v) AS ssw, count(*) AS k, sum(n) AS n FROM
(SELECT *, sum(n * m) OVER () / sum(n) OVER () AS mm FROM (SELECT grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {ORDER_SQL} o GROUP BY grp)))"""


@query(f"SELECT 'o_totalprice' AS feature, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM {ANOVA_SQL} a")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.anova(order_prices(spark, sf_dir)).select("feature", *r6("f"), "df1", "df2")


@query(f"SELECT round({f_p('f', 'df1', 'df2')}, 8) AS p_value FROM (SELECT (ssb / (k - 1)) / (ssw / (n - k)) AS f, k - 1 AS df1, n - k AS df2 FROM {ANOVA_SQL} a)")
def anova_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.anova(order_prices(spark, sf_dir)).select(*r8("p_value"))


@query(f"""WITH g AS (SELECT grp, count(*) AS n, avg(value) AS m FROM {ORDER_SQL} o GROUP BY grp), a AS {ANOVA_SQL}
SELECT x.grp AS group1, y.grp AS group2, round(y.m - x.m, 4) + 0.0 AS meandiff, round(abs(y.m - x.m) / sqrt(ssw / (a.n - k) / 2 * (1.0 / x.n + 1.0 / y.n)), 6) AS q
FROM g x JOIN g y ON x.grp < y.grp, a""")
def tukey_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = t.tukey(order_prices(spark, sf_dir))
    return got.select("group1", "group2", (F.round("meandiff", 4) + F.lit(0.0)).alias("meandiff"), *r6("q"))


TUKEY_Q = f"""(WITH g AS (SELECT grp, count(*) AS n, avg(value) AS m FROM {ORDER_SQL} o GROUP BY grp), a AS {ANOVA_SQL}
SELECT x.grp AS group1, y.grp AS group2, abs(y.m - x.m) / sqrt(ssw / (a.n - k) / 2 * (1.0 / x.n + 1.0 / y.n)) AS q, CAST(k AS DOUBLE) AS k, CAST(a.n - k AS DOUBLE) AS df FROM g x JOIN g y ON x.grp < y.grp, a)"""


@query(f"SELECT group1, group2, round(p_value, 5) + 0.0 AS p_adj, p_value < 0.05 AS reject FROM {range_p(TUKEY_Q, 'group1, group2')} p")
def tukey_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = t.tukey(order_prices(spark, sf_dir))
    return got.select("group1", "group2", (F.round("p_adj", 5) + F.lit(0.0)).alias("p_adj"), "reject")


@query(f"SELECT group1, group2, round(p_adj, 5) + 0.0 AS p_adj, reject FROM (SELECT group1, group2, p_value < 0.05 AS reject, p_adj FROM {bh(range_p(TUKEY_Q, 'group1, group2'), 'group1, group2')} b)")
def tukey_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted once more."""
    got = t.tukey(order_prices(spark, sf_dir), correct_again=True)
    return got.select("group1", "group2", (F.round("p_adj", 5) + F.lit(0.0)).alias("p_adj"), "reject")


RANKS = """(SELECT grp, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY value) AS c FROM
(SELECT l_returnflag AS grp, l_quantity AS value FROM lineitem {where}))"""


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_to_long(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity"])


@query(f"""WITH r AS {RANKS.format(where='')}, n AS (SELECT count(*)::DOUBLE AS n, sum(c * c - 1.0) AS tie FROM r), s AS (SELECT sum(x) AS s FROM (SELECT sum(r) ** 2 / count(*) AS x FROM r GROUP BY grp))
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n ** 3 - n)), 6) AS h FROM n, s""")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.kruskal(quantities(spark, sf_dir)).select(*r6("h"))


@query(f"""WITH r AS {RANKS.format(where='')}, g AS (SELECT grp, avg(r) AS m, count(*) AS k FROM r GROUP BY grp), n AS (SELECT count(*)::DOUBLE AS n FROM r)
SELECT x.grp AS group1, y.grp AS group2, round((x.m - y.m) / sqrt(n * (n + 1) / 12 * (1.0 / x.k + 1.0 / y.k)), 6) + 0.0 AS z FROM g x JOIN g y ON x.grp < y.grp, n""")
def dunn_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.dunn(quantities(spark, sf_dir)).select("group1", "group2", *r6("z"))


@query(f"""WITH r AS {RANKS.format(where="WHERE l_returnflag IN ('A', 'R')")}, n AS (SELECT count(*)::DOUBLE AS n, sum(c * c - 1.0) AS tie, count(*) FILTER (grp = 'A')::DOUBLE AS n1, count(*) FILTER (grp = 'R')::DOUBLE AS n2, sum(r) FILTER (grp = 'A') AS r1 FROM r)
SELECT round(r1 - n1 * (n1 + 1) / 2, 1) AS u, round((greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))), 6) AS z FROM n""")
def mannwhitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.mann_whitney(quantities(spark, sf_dir), "A", "R").select(F.round("u", 1).alias("u"), *r6("z"))


@query(f"""WITH r AS {RANKS.format(where='')}, n AS (SELECT count(*)::DOUBLE AS n, sum(c * c - 1.0) AS tie FROM r), s AS (SELECT sum(x) AS s, count(*) AS k FROM (SELECT sum(r) ** 2 / count(*) AS x FROM r GROUP BY grp)),
h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n ** 3 - n)) AS h, k - 1 AS df FROM n, s)
SELECT round({chi2_p('h', 'df')}, 8) AS p_value, df::DOUBLE AS df FROM h""")
def kruskal_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.kruskal(quantities(spark, sf_dir)).select(*r8("p_value"), "df")


DUNN_Z = f"""(WITH r AS {RANKS.format(where='')}, g AS (SELECT grp, avg(r) AS m, count(*) AS k FROM r GROUP BY grp), n AS (SELECT count(*)::DOUBLE AS n FROM r)
SELECT x.grp AS group1, y.grp AS group2, (x.m - y.m) / sqrt(n * (n + 1) / 12 * (1.0 / x.k + 1.0 / y.k)) AS z FROM g x JOIN g y ON x.grp < y.grp, n)"""


@query(f"SELECT group1, group2, round(p_value, 8) AS p_value, round(p_adj, 8) AS p_adj, p_adj < 0.05 AS reject FROM {bh(f'(SELECT *, {NORMAL_Z} AS p_value FROM {DUNN_Z} d)', 'group1, group2')} a")
def dunn_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.dunn(quantities(spark, sf_dir)).select("group1", "group2", *r8("p_value", "p_adj"), "reject")


MANN = """(WITH r AS {ranks}, n AS (SELECT count(*)::DOUBLE AS n, sum(c * c - 1.0) AS tie, count(*) FILTER (grp = '{a}')::DOUBLE AS n1, count(*) FILTER (grp = '{b}')::DOUBLE AS n2, sum(r) FILTER (grp = '{a}') AS r1 FROM r)
SELECT '{a}' AS group1, '{b}' AS group2, r1 - n1 * (n1 + 1) / 2 AS u, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))) AS z FROM n)"""


def _mann(a: str, b: str) -> str:
    return MANN.format(a=a, b=b, ranks=RANKS.format(where=f"WHERE l_returnflag IN ('{a}', '{b}')"))


@query(f"SELECT round(u, 1) AS u, round(least(1.0, {normal_p('z')}), 8) AS p_value FROM {_mann('A', 'R')} m")
def mannwhitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.mann_whitney(quantities(spark, sf_dir), "A", "R").select(F.round("u", 1).alias("u"), *r8("p_value"))


P_SQL = "(SELECT p_partkey AS feature, p_size / (p_retailprice + 0.001 * p_partkey) AS p_value FROM part)"


def part_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers between 0 and 1 that stand in for p-values."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), (F.col("p_size") / (F.col("p_retailprice") + 0.001 * F.col("p_partkey"))).alias("p_value"))


def _padjust_sql(value: str) -> str:
    return f"""WITH p AS {P_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS r, count(*) OVER () AS m FROM p)
SELECT feature, round(least(1.0, {value}), 8) AS p_adj FROM r"""


_DOWN = "OVER (ORDER BY p_value DESC, feature DESC ROWS UNBOUNDED PRECEDING)"


@query(_padjust_sql(f"min(p_value * m / r) {_DOWN}"))
def padjust_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.adjust(part_ratios(spark, sf_dir), "fdr_bh").select("feature", F.round("p_adj", 8).alias("p_adj"))


@query(_padjust_sql(f"min(p_value * m * (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) FROM part) + 1) x(i)) / r) {_DOWN}"))
def padjust_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.adjust(part_ratios(spark, sf_dir), "fdr_by").select("feature", F.round("p_adj", 8).alias("p_adj"))


@query(_padjust_sql("max(p_value * (m - r + 1)) OVER (ORDER BY p_value, feature ROWS UNBOUNDED PRECEDING)"))
def padjust_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.adjust(part_ratios(spark, sf_dir), "holm").select("feature", F.round("p_adj", 8).alias("p_adj"))


@query(_padjust_sql("p_value * m"))
def padjust_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.adjust(part_ratios(spark, sf_dir), "bonferroni").select("feature", F.round("p_adj", 8).alias("p_adj"))


@query(f"""WITH g AS (SELECT feature, grp, avg(value) AS m, var_samp(value) AS v FROM {LINES} l GROUP BY ALL)
SELECT x.feature, x.grp AS group1, y.grp AS group2, round((x.m - y.m) / sqrt((x.v + y.v) / 2), 6) + 0.0 AS d FROM g x JOIN g y ON x.feature = y.feature AND x.grp < y.grp""")
def pairwise_cohen_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.cohen_d(lines(spark, sf_dir)).select("feature", "group1", "group2", *r6("d"))


@query("WITH g AS (SELECT DISTINCT c_mktsegment AS g FROM customer) SELECT x.g AS group1, y.g AS group2 FROM g x JOIN g y ON x.g < y.g")
def group_pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.group_pairs(table(spark, sf_dir, "customer"), "c_mktsegment")


ANOVAS = f"""(SELECT feature, sum(n * (m - mm) ** 2) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f, count(*) - 1 AS df1, sum(n) - count(*) AS df2 FROM
(SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS mm FROM (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {LINES} l GROUP BY ALL)) GROUP BY feature)"""


@query(f"SELECT feature, round(f, 6) + 0.0 AS statistic, round(p_value, 8) AS p_value, round(p_adj, 8) AS p_adj, {stars('p_adj')} AS stars FROM {bh(f'(SELECT *, {F_TAIL} AS p_value FROM {ANOVAS} a)', 'feature')} b")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = t.p_value_table(table(spark, sf_dir, "lineitem"), "l_returnflag", value_cols=NUMBERS)
    return got.select("feature", *r6("statistic"), *r8("p_value", "p_adj"), "stars")


PAIRS_T = f"""(SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM
(WITH g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {LINES} l GROUP BY ALL)
SELECT x.feature, x.grp AS group1, y.grp AS group2, x.n AS na, x.m AS ma, x.v AS va, y.n AS nb, y.m AS mb, y.v AS vb FROM g x JOIN g y ON x.feature = y.feature AND x.grp < y.grp))"""
PAIRS_P = f"(SELECT feature, group1, group2, t AS statistic, {t_p('t', 'df')} AS p_value FROM {PAIRS_T} pt)"
MANNS = "(SELECT 'l_quantity' AS feature, group1, group2, u AS statistic, least(1.0, " + normal_p("z") + ") AS p_value FROM (" + " UNION ALL ".join(f"SELECT * FROM {_mann(a, b)} m" for a, b in (("A", "N"), ("A", "R"), ("N", "R"))) + "))"


@query(f"""SELECT feature, group1, group2, round(statistic, 4) + 0.0 AS statistic, round(p_value, 8) AS p_value, round(p_adj, 8) AS p_adj FROM {bh(PAIRS_P, 'feature, group1, group2')} a
UNION ALL SELECT feature, group1, group2, round(statistic, 4) + 0.0, round(p_value, 8), round(p_adj, 8) FROM {bh(MANNS, 'feature, group1, group2')} b""")
def pairwise_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = t.pairwise(lines(spark, sf_dir)).unionByName(t.pairwise(quantities(spark, sf_dir), "mannwhitney"))
    return both.select("feature", "group1", "group2", (F.round("statistic", 4) + F.lit(0.0)).alias("statistic"), *r8("p_value", "p_adj"))


@query("""WITH l AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS value, CAST(label AS DOUBLE) AS y FROM embeddings)
SELECT j, round(regr_slope(value, y), 8) + 0.0 AS slope, round(regr_intercept(value, y), 6) + 0.0 AS intercept, round(regr_r2(value, y), 8) AS r2 FROM l GROUP BY j""")
def feature_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.matrix import to_long
    from .columns import matrix

    got = t.regression(to_long(matrix(spark, sf_dir), F.col("grp").cast("double").alias("y")))
    return got.select("j", (F.round("slope", 8) + F.lit(0.0)).alias("slope"), *r6("intercept"), F.round("r2", 8).alias("r2"))

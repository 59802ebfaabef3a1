"""Group tests and multiple-testing corrections.

Every test starts from one aggregation of count, mean and variance (or of
counted ranks) for each feature and group; what follows runs on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import dist
from ..functions.scalars import neg_log10, regulation, stars
from ..plans.matrix import tidy_to_long
from .colstats import anchor_correlation, average_ranks


def group_moments(long: DataFrame) -> DataFrame:
    """feature, grp, n, m, v."""
    return long.groupBy("feature", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))


def two_groups(long: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each feature with both groups' moments, by conditional aggregation: one scan, one shuffle of partial sums."""
    of = lambda g: F.when(F.col("grp") == g, F.col("value"))
    return long.where(F.col("grp").isin(a, b)).groupBy("feature").agg(*[f(of(g)).alias(f"{n}{s}") for g, s in ((a, "a"), (b, "b")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])


def welch(moments: DataFrame) -> DataFrame:
    """Adds t and df (Satterthwaite) to ``two_groups``; NULL if a group has one row or both are constant."""
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") > 1) & (F.col("nb") > 1) & (sa + sb > 0)
    parts = F.when(ok, (sa + sb) * (sa + sb) / (sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1)))
    return moments.withColumn("t", F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt(sa + sb))).withColumn("df", parts)


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m without m terms: beyond 100, the expansion log m + Euler's constant + 1/2m - 1/12m^2 + 1/120m^4, exact to the last digits."""
    x = m.cast("double")
    short = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(100)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return F.when(m <= 100, short).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def adjust(df: DataFrame, method: str = "fdr_bh", p: str = "p_value", key: str = "feature", out: str = "p_adj") -> DataFrame:
    """Adjusted p-values; rows with NULL p stay NULL and do not count.

    One row for each feature: the only global sort of the library runs on these.
    """
    if method not in ("fdr_bh", "fdr_by", "bonferroni", "holm", None):
        raise ValueError(f"unknown correction {method}")
    if method is None:
        return df.withColumn(out, F.col(p))
    some, none = df.where(F.col(p).isNotNull() & ~F.isnan(p)), df.where(F.col(p).isNull() | F.isnan(p))
    up, down = Window.orderBy(F.col(p), F.col(key)), Window.orderBy(F.desc(p), F.desc(key))
    rows = some.withColumn("_m", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("_r", F.row_number().over(up))
    if method == "bonferroni":
        value = F.col(p) * F.col("_m")
    elif method == "holm":
        value = F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        scale = F.lit(1.0) if method == "fdr_bh" else harmonic(F.col("_m"))
        rows = rows.withColumn("_s", scale)
        value = F.min(F.col(p) * F.col("_m") * F.col("_s") / F.col("_r")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    done = rows.withColumn(out, F.least(F.lit(1.0), value)).select(*df.columns, out)
    return done.unionByName(none.withColumn(out, F.lit(None).cast("double")))


def volcano(df: DataFrame, group: str, a: str, b: str, value_cols: list[str] | None = None, p_limit: float = 0.05, fc_limit: float = 1.0, correct: str | None = "fdr_bh") -> DataFrame:
    """feature, log2FC, t, df, p_value, p_adj, neg_log10_p, label of each numeric column."""
    m = welch(two_groups(tidy_to_long(df, group, value_cols), a, b))
    fc = F.when((F.col("ma") > 0) & (F.col("mb") > 0), F.log2(F.col("mb") / F.col("ma"))).when((F.col("ma") == 0) & (F.col("mb") == 0), F.lit(0.0))
    rows = m.withColumn("log2FC", fc).withColumn("p_value", dist.t_p_value("t", "df"))
    rows = adjust(rows, correct)
    return rows.select("feature", "log2FC", "t", "df", "p_value", "p_adj", neg_log10(F.col("p_adj")).alias("neg_log10_p"), regulation(F.col("log2FC"), F.col("p_adj"), fc_limit, p_limit).alias("label"))


def fold_change(df: DataFrame, group: str, a: str, b: str, value_cols: list[str] | None = None, log2: bool = True, p_limit: float = 0.05, fc_limit: float = 1.0) -> DataFrame:
    """feature, fc, p_value, label (limits included); fc and p are NULL where a group has under two rows or the first mean is 0."""
    m = welch(two_groups(tidy_to_long(df, group, value_cols), a, b))
    ratio = F.when((F.col("na") > 1) & (F.col("nb") > 1) & (F.col("ma") != 0), F.col("mb") / F.col("ma"))
    fc = F.when(ratio > 0, F.log2(ratio)) if log2 else ratio
    rows = m.withColumn("fc", fc).withColumn("p_value", dist.t_p_value("t", "df"))
    return rows.select("feature", "fc", "t", "p_value", regulation(F.col("fc"), F.col("p_value"), fc_limit, p_limit, inclusive=True).alias("label"))


def anova(long: DataFrame) -> DataFrame:
    """feature, f, df1, df2, p_value; NULL with fewer than two groups or no variance within."""
    g = group_moments(long)
    w = Window.partitionBy("feature")
    g = g.withColumn("_m", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_m"), 2)).alias("ssb"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"), F.count("*").alias("k"), F.sum("n").alias("n"))
    s = s.withColumn("df1", (F.col("k") - 1).cast("double")).withColumn("df2", (F.col("n") - F.col("k")).cast("double"))
    f = F.when((F.col("df1") > 0) & (F.col("df2") > 0) & (F.col("ssw") > 0), (F.col("ssb") / F.col("df1")) / (F.col("ssw") / F.col("df2")))
    return s.withColumn("f", f).withColumn("p_value", dist.f_p_value("f", "df1", "df2")).select("feature", "f", "df1", "df2", "ssw", "p_value")


def group_pairs(df: DataFrame, group: str = "grp") -> DataFrame:
    """Unordered pairs (group1 < group2) of the groups present."""
    g = df.select(F.col(group).alias("g")).where("g IS NOT NULL").distinct()
    return g.select(F.col("g").alias("group1")).join(g.select(F.col("g").alias("group2")), F.col("group1") < F.col("group2"))


def tukey(long: DataFrame, correct_again: bool = False, threshold: float = 0.05) -> DataFrame:
    """feature, group1, group2, meandiff, q, p_adj, reject (Tukey-Kramer). ``correct_again`` adjusts p once more by BH and leaves ``reject`` alone."""
    g = group_moments(long)
    a = anova(long).select("feature", (F.col("ssw") / F.col("df2")).alias("mse"), "df2", (F.col("df1") + 1).alias("k"))
    x, y = (g.select("feature", F.col("grp").alias(f"group{i}"), F.col("n").alias(f"n{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
    p = x.join(y, "feature").where("group1 < group2").join(a, "feature")
    p = p.withColumn("meandiff", F.col("m2") - F.col("m1")).withColumn("q", F.when(F.col("mse") > 0, F.abs("meandiff") / F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))))
    p = p.withColumn("p_adj", dist.range_p_value("q", "k", "df2")).withColumn("reject", F.col("p_adj") < threshold)
    if correct_again:
        p = adjust(p.withColumn("_key", F.concat_ws("|", "feature", "group1", "group2")), "fdr_bh", "p_adj", "_key", "_again").withColumn("p_adj", F.col("_again"))
    return p.select("feature", "group1", "group2", "meandiff", "q", "p_adj", "reject")


def _ranked(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature, grp, n, rank sum), (feature, n, tie term) from counted distinct values."""
    ranks = average_ranks(long, ["feature"], "value")
    per = long.groupBy("feature", "grp", "value").agg(F.count("*").alias("c")).join(ranks, ["feature", "value"])
    sums = per.groupBy("feature", "grp").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    ties = F.col("ties").cast("double")
    total = ranks.groupBy("feature").agg(F.sum("ties").alias("total"), F.sum(ties * ties * ties - ties).alias("tie"))
    return sums, total


def kruskal(long: DataFrame) -> DataFrame:
    """feature, h (tie-corrected), df, p_value."""
    sums, total = _ranked(long)
    n = F.col("total").cast("double")
    s = sums.groupBy("feature").agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k")).join(total, "feature")
    fix = 1 - F.col("tie") / (n * n * n - n)
    h = F.when((F.col("k") > 1) & (n > 1) & (fix > 0), (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / fix)
    s = s.withColumn("h", h).withColumn("df", (F.col("k") - 1).cast("double"))
    return s.withColumn("p_value", dist.chi2_p_value("h", "df")).select("feature", "h", "df", "p_value")


def dunn(long: DataFrame, ties: bool = False, correct: str = "fdr_bh", threshold: float = 0.05) -> DataFrame:
    """feature, group1, group2, z, p_value, p_adj, reject; ``ties`` applies the tie correction of the literature, which the plain form leaves out."""
    sums, total = _ranked(long)
    x, y = (sums.select("feature", F.col("grp").alias(f"group{i}"), F.col("n").alias(f"n{i}"), (F.col("r") / F.col("n")).alias(f"r{i}")) for i in (1, 2))
    p = x.join(y, "feature").where("group1 < group2").join(total, "feature")
    n = F.col("total").cast("double")
    var = n * (n + 1) / 12 - (F.col("tie") / (12 * (n - 1)) if ties else F.lit(0.0))
    se = F.sqrt(var * (1 / F.col("n1") + 1 / F.col("n2")))
    p = p.withColumn("z", F.when(se > 0, (F.col("r1") - F.col("r2")) / se).otherwise(0.0)).withColumn("p_value", dist.normal_p_value("z"))
    p = adjust(p.withColumn("_key", F.concat_ws("|", "feature", "group1", "group2")), correct, key="_key")
    return p.select("feature", "group1", "group2", "z", "p_value", "p_adj", (F.col("p_adj") < threshold).alias("reject"))


def mann_whitney(long: DataFrame, a: str, b: str) -> DataFrame:
    """feature, u (of the first group), z, p_value: normal approximation with tie and continuity correction, or exact counts if a group has at most 8 rows and nothing ties."""
    both = long.where(F.col("grp").isin(a, b))
    sums, total = _ranked(both)
    of = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c))).cast("double")
    s = sums.groupBy("feature").agg(of(a, "n").alias("n1"), of(a, "r").alias("r1"), of(b, "n").alias("n2")).join(total, "feature")
    n = F.col("total").cast("double")
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    mid = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.when(n > 1, F.col("tie") / (n * (n - 1))).otherwise(0.0)))
    s = s.withColumn("z", F.when(sd > 0, (F.greatest(F.col("u"), F.col("n1") * F.col("n2") - F.col("u")) - mid - 0.5) / sd))
    s = s.withColumn("p_value", F.when((F.least("n1", "n2") <= 8) & (F.col("tie") == 0) & (n <= 200), _exact_u("u", "n1", "n2")).otherwise(F.least(F.lit(1.0), dist.normal_p_value("z"))))
    return s.select("feature", "u", "z", "n1", "n2", "p_value")


@F.pandas_udf(DoubleType())
def _exact_u(u, n1, n2):
    import numpy as np
    import pandas as pd

    def tail(u0, a, b):
        if pd.isna(u0) or pd.isna(a) or pd.isna(b) or min(a, b) > 8 or a + b > 200 or u0 != int(u0):
            return None
        small, large = int(min(a, b)), int(max(a, b))
        ways = np.zeros((small + 1, small * large + 1))  # subsets of ranks by size and excess sum
        ways[0, 0] = 1.0
        for item in range(1, small + large + 1):
            for k in range(min(small, item), 0, -1):
                low = item - k
                if low <= small * large:
                    ways[k, low:] += ways[k - 1, : small * large + 1 - low]
        counts = ways[small]
        high = int(max(u0, a * b - u0))
        return min(1.0, 2 * counts[high:].sum() / counts.sum())

    return pd.Series([tail(*v) for v in zip(u, n1, n2, strict=True)], dtype=float)


def p_value_table(df: DataFrame, group: str, test: str = "auto", value_cols: list[str] | None = None, correct: str = "fdr_bh") -> DataFrame:
    """feature, statistic, p_value, p_adj, stars. ``auto``: Welch for two groups, ANOVA for more."""
    groups = sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().collect())
    if test == "auto":
        test = "ttest" if len(groups) == 2 else "anova"
    long = tidy_to_long(df, group, value_cols)
    if test in ("ttest", "mannwhitney") and len(groups) != 2:
        raise ValueError("the test needs exactly two groups")
    if test == "ttest":
        rows = welch(two_groups(long, *groups)).select("feature", F.col("t").alias("statistic"), dist.t_p_value("t", "df").alias("p_value"))
    elif test == "mannwhitney":
        rows = mann_whitney(long, *groups).select("feature", F.col("u").alias("statistic"), "p_value")
    elif test == "anova":
        rows = anova(long).select("feature", F.col("f").alias("statistic"), "p_value")
    elif test == "kruskal":
        rows = kruskal(long).select("feature", F.col("h").alias("statistic"), "p_value")
    else:
        raise ValueError(f"unknown test {test}")
    return adjust(rows, correct).withColumn("stars", stars(F.col("p_adj")))


def cohen_d(long: DataFrame) -> DataFrame:
    """feature, group1, group2, d over the mean of both variances."""
    g = group_moments(long)
    x, y = (g.select("feature", F.col("grp").alias(f"group{i}"), F.col("m").alias(f"m{i}"), F.col("v").alias(f"v{i}")) for i in (1, 2))
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    return x.join(y, "feature").where("group1 < group2").select("feature", "group1", "group2", F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).alias("d"))


def pairwise(long: DataFrame, test: str = "ttest", correct: str = "fdr_bh") -> DataFrame:
    """feature, group1, group2, statistic, p_value, p_adj of every pair of groups, Welch or Mann-Whitney."""
    if test == "ttest":
        g = group_moments(long)
        x, y = (g.select("feature", F.col("grp").alias(f"group{i}"), *[F.col(c).alias(f"{c}{s}") for c in ("n", "m", "v")]) for i, s in ((1, "a"), (2, "b")))
        rows = welch(x.join(y, "feature").where("group1 < group2")).withColumn("p_value", dist.t_p_value("t", "df")).select("feature", "group1", "group2", F.col("t").alias("statistic"), "p_value")
    else:
        pairs = [(r["group1"], r["group2"]) for r in group_pairs(long).collect()]
        parts = [mann_whitney(long, a, b).select("feature", F.lit(a).alias("group1"), F.lit(b).alias("group2"), F.col("u").alias("statistic"), "p_value") for a, b in sorted(pairs)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
    return adjust(rows.withColumn("_key", F.concat_ws("|", "feature", "group1", "group2")), correct, key="_key").drop("_key")


def stocsy(matrix: DataFrame, anchor: int, p_limit: float = 1e-4) -> DataFrame:
    """j, r, p_value, significant: correlation with an anchor feature. Two samples give p = 1, |r| = 1 gives p = 0, constants NULL."""
    got = anchor_correlation(matrix, anchor)
    p = F.when(F.col("r").isNull(), None).when(F.col("n") <= 2, F.lit(1.0)).when(F.abs("r") >= 1, F.lit(0.0)).otherwise(dist.t_p_value("t", (F.col("n") - 2).cast("double")))
    return got.withColumn("p_value", p).select("j", "r", "p_value", (F.col("p_value") < p_limit).alias("significant"))


def regression(long: DataFrame, y: str = "y") -> DataFrame:
    """j, slope, intercept, r2, t of each feature's straight line against ``y``."""
    s = long.where(F.col("value").isNotNull() & F.col(y).isNotNull()).groupBy("j").agg(F.count("*").alias("n"), F.avg("value").alias("my"), F.avg(y).alias("mx"), F.var_pop("value").alias("vy"), F.var_pop(y).alias("vx"), F.covar_pop("value", y).alias("c"))
    r2 = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") * F.col("c") / (F.col("vx") * F.col("vy")))
    s = s.withColumn("slope", F.when(F.col("vx") > 0, F.col("c") / F.col("vx"))).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("r2", r2)
    t = F.when((F.col("n") > 2) & (F.col("r2") < 1), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    return s.withColumn("t", t).withColumn("p_value", dist.t_p_value("t", (F.col("n") - 2).cast("double"))).select("j", "slope", "intercept", "r2", "t", "p_value")

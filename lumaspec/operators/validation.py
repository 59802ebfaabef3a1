"""Splits, folds, out-of-fold scores and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def _dealt(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Rows with their hash-ordered number within their class, from 1, and the class's size."""
    w = Window.partitionBy(label)
    return df.withColumn("_r", F.row_number().over(w.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))).withColumn("_n", F.count("*").over(w))


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with ``role``: exactly round(size * test) rows of each class are ``test``."""
    rows = _dealt(df, key, label, seed)
    return rows.withColumn("role", F.when(F.col("_r") <= F.round(F.col("_n") * test), "test").otherwise("train")).drop("_r", "_n")


def class_balance(split: DataFrame, label: str) -> DataFrame:
    """label, n_train, n_test and the parts of 100 of each role, to one digit."""
    g = split.groupBy(label).agg(*[F.sum((F.col("role") == r).cast("long")).alias(f"n_{r}") for r in ("train", "test")])
    every = Window.partitionBy(F.lit(0))
    return g.select(label, "n_train", "n_test", *[F.round(100 * F.col(f"n_{r}") / F.sum(f"n_{r}").over(every), 1).alias(f"pct_{r}") for r in ("train", "test")])


SPLITTERS = ("kfold", "stratified_kfold", "loo", "leave_p_out", "repeated_kfold", "shuffle_split", "group_kfold", "time_series")


def folds(df: DataFrame, key: str, strategy: str = "kfold", k: int = 5, label: str | None = None, group: str | None = None, order: str | None = None, repeats: int = 5, test: float = 0.2, p: int = 2, seed: int = 42) -> DataFrame:
    """(key, repeat, fold, role) of each row and fold.

    Orders come from a hash of the key and the seed, so the assignment does not
    depend on partitions. ``kfold`` and ``time_series`` number the rows of the
    whole table, range by range of their order (a text order is one range).
    """
    if strategy not in SPLITTERS:
        raise ValueError(f"strategy must be one of {SPLITTERS}")
    spark = df.sparkSession

    def numbered(rows: DataFrame, *order: Column) -> DataFrame:
        """Rows with ``_r``, their number from 0 in the order of a hash or of ``order``, counted range by range."""
        from .colstats import RANGES, in_ranges

        if order:
            first = rows.withColumn("_o", order[0])
            ranged = in_ranges(first, "_o") if isinstance(first.schema["_o"].dataType, NumericType | DateType | TimestampType | TimestampNTZType) else first.withColumn("_range", F.lit(0))
        else:
            first = rows.withColumn("_o", F.xxhash64(F.col(key), F.lit(seed)))
            ranged = first.withColumn("_range", F.floor((F.col("_o") / 2.0**63 + 1) * (RANGES / 2)).cast("int"))
        sizes = ranged.groupBy("_range").agg(F.count("*").alias("_c"))
        before = sizes.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most RANGES rows
        inner = F.row_number().over(Window.partitionBy("_range").orderBy("_o", *order[1:], key)) - 1
        return ranged.withColumn("_i", inner).join(F.broadcast(before), "_range").withColumn("_r", F.col("_i") + F.col("_before")).drop("_o", "_i", "_range", "_before")

    def spread(rows: DataFrame, fold: Column, n: int, repeat: Column) -> DataFrame:
        each = rows.withColumn("_f", fold).withColumn("repeat", repeat).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return each.select(key, "repeat", "fold", F.when(F.col("_f") == F.col("fold"), "test").otherwise("train").alias("role"))

    if strategy == "kfold":
        return spread(numbered(df), F.col("_r") % k, k, F.lit(0))
    if strategy == "stratified_kfold":
        return spread(_dealt(df, key, label, seed), (F.col("_r") - 1) % k, k, F.lit(0))
    if strategy == "repeated_kfold":
        parts = [spread(_dealt(df, key, label, seed + r), (F.col("_r") - 1) % k, k, F.lit(r)) for r in range(repeats)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    if strategy in ("loo", "leave_p_out"):
        ids = [r[0] for r in df.select(key).orderBy(key).collect()]  # a fold for each sample, or set of p
        from itertools import combinations

        held = spark.createDataFrame([(i, x) for i, c in enumerate(combinations(ids, 1 if strategy == "loo" else p)) for x in c], f"fold int, held {df.schema[key].dataType.simpleString()}")
        sets = held.groupBy("fold").agg(F.collect_set("held").alias("held"))  # p ids each
        got = sets.join(df.select(key), how="cross")
        return got.select(key, F.lit(0).alias("repeat"), "fold", F.when(F.array_contains("held", F.col(key)), "test").otherwise("train").alias("role"))
    if strategy == "shuffle_split":
        each = df.select(key).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        w = Window.partitionBy("fold")
        each = each.withColumn("_r", F.row_number().over(w.orderBy(F.xxhash64(F.col(key), F.col("fold"), F.lit(seed)), key))).withColumn("_n", F.count("*").over(w))
        return each.select(key, F.lit(0).alias("repeat"), "fold", F.when(F.col("_r") <= F.ceil(F.col("_n") * test), "test").otherwise("train").alias("role"))
    if strategy == "group_kfold":
        sizes = sorted(((r["n"], r[0]) for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], str(x[1])))
        load, place = [0] * k, []
        for n, g in sizes:  # largest group to the emptiest fold
            f = load.index(min(load))
            load[f] += n
            place.append((g, f))
        named = spark.createDataFrame(place, f"`{group}` {df.schema[group].dataType.simpleString()}, _g int")
        return spread(df.join(named, group), F.col("_g"), k, F.lit(0))
    rows = numbered(df, F.col(order or key)).withColumn("_n", F.lit(df.count()))
    size = F.floor(F.col("_n") / (k + 1))
    start = F.col("_n") - size * (k - F.col("fold"))
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("_r") < start + size)
    return each.select(key, F.lit(0).alias("repeat"), "fold", F.when(F.col("_r") >= start, "test").otherwise("train").alias("role"))


def contiguous_folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """(key, label, fold): blocks of ceil(n / k) rows of each class in row order."""
    w = Window.partitionBy(label)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count("*").over(w))
    return rows.select(key, label, F.floor(F.col("_r") / F.ceil(F.col("_n") / k)).cast("int").alias("fold"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n, share (of the actual class) on the whole grid of classes."""
    counts = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    classes = df.select(F.col(actual).alias("c")).unionByName(df.select(F.col(predicted).alias("c"))).distinct()
    grid = classes.select(F.col("c").alias(actual)).join(classes.select(F.col("c").alias(predicted)), how="cross")  # classes squared
    rows = grid.join(counts, [actual, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(actual))
    return rows.withColumn("share", F.when(total > 0, F.col("n") / total))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, tpr, fpr from the largest score down; equal scores are one point. Distinct scores are counted first."""
    from .colstats import running_before

    g = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    rows = running_before(g.withColumn("_k", F.lit(0)), ["_k"], score, ["p", "n"], descending=True)
    every = g.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # one row
    rows = rows.join(F.broadcast(every), how="cross")
    return rows.select(score, ((F.col("p_before") + F.col("p")) / F.col("_p")).alias("tpr"), ((F.col("n_before") + F.col("n")) / F.col("_n")).alias("fpr"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the curve in its rank form."""
    from .colstats import average_ranks

    ranks = average_ranks(df.withColumn("_k", F.lit(0)), ["_k"], score)
    s = df.join(ranks, score).agg(F.sum(F.when(F.col(label) == 1, F.col("rank"))).alias("r"), F.sum((F.col(label) == 1).cast("double")).alias("p"), F.sum((F.col(label) != 1).cast("double")).alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def one_vs_rest_auc(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """class, auc: of each class's score (a column of its name) against all others, and ``micro``: of all pairs of row and class together."""
    from .colstats import running_before

    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce((F.col(label) == c).cast("int"), F.lit(0)).alias("y"), F.col(c).cast("double").alias("score")) for c in classes])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("score IS NOT NULL")
    # Equal scores are counted once for each class before anything is ranked.
    counts = rows.groupBy("class", "score").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    micro = counts.groupBy("score").agg(F.sum("p").alias("p"), F.sum("c").alias("c")).select(F.lit("micro").alias("class"), "score", "p", "c")
    both = counts.unionByName(micro)
    ranked = running_before(both, ["class"], "score", ["c"])
    s = ranked.groupBy("class").agg(F.sum(F.col("p") * (F.col("c_before") + (F.col("c") + 1) / 2)).alias("r"), F.sum("p").cast("double").alias("p"), F.sum(F.col("c") - F.col("p")).cast("double").alias("n"))
    return s.select("class", F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy, balanced accuracy and macro F1."""
    t = df.select(F.col(actual).alias("a"), F.col(predicted).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    hit = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    rec = t.groupBy(F.col("a").alias("c")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("actual"))
    pre = t.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("called"))
    both = rec.join(pre, "c", "full").fillna(0)
    f1 = F.when(F.col("actual") + F.col("called") > 0, 2 * F.col("tp") / (F.col("actual") + F.col("called"))).otherwise(0.0)
    return both.agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg(F.when(F.col("actual") > 0, F.col("tp") / F.col("actual"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def fold_summary(scores: DataFrame, value: str = "score") -> DataFrame:
    """mean, std (population), min, max to 4 digits."""
    return scores.agg(*[F.round(f(value), 4).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def bootstrap_interval(df: DataFrame, key: str, actual: str, predicted: str, rounds: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: low, mean, high of the accuracy on out-of-bag rows of resamples.

    A resample holds a row with probability 1 - exp(-1); a hash of (row, round)
    decides, so no sample is drawn on the driver.
    """
    each = df.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    out = F.pmod(F.xxhash64(F.col(key), F.col("_b"), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * 0.36787944)
    acc = each.where(out).groupBy("_b").agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("a"))
    tail = (1 - level) / 2
    return acc.agg(F.percentile("a", tail).alias("low"), F.avg("a").alias("mean"), F.percentile("a", 1 - tail).alias("high"))


def feature_cv(long: DataFrame) -> DataFrame:
    """One row: median over features of the coefficient of variation in parts of 100."""
    g = long.groupBy("j").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("m <> 0")
    return g.agg(F.median(F.abs(100 * F.col("s") / F.col("m"))).alias("median_cv"))


def replicate_cv(long: DataFrame) -> DataFrame:
    """grp, mean over features of the coefficient of variation within the group."""
    g = long.groupBy("grp", "j").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("m <> 0")
    return g.groupBy("grp").agg(F.avg(F.abs(100 * F.col("s") / F.col("m"))).alias("cv"))


def replicate_correlation(matrix: DataFrame) -> DataFrame:
    """grp, mean Pearson correlation over all pairs of the group's samples, linear in the samples: (|sum of unit spectra|**2 - n) / (n (n - 1))."""
    from ..functions.scalars import unit_values
    from ..plans.matrix import to_long

    unit = matrix.select("sample_id", "grp", unit_values(F.col("values")).alias("values")).where("values IS NOT NULL")
    s = to_long(unit).groupBy("grp", "j").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    t = s.groupBy("grp").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("n").alias("n"))
    return t.select("grp", F.when(F.col("n") > 1, (F.col("s2") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("r"))


def dispersion(long: DataFrame) -> DataFrame:
    """grp, mean distance of the group's samples to its centre."""
    centre = long.groupBy("grp", "j").agg(F.avg("value").alias("c"))
    d = long.join(centre, ["grp", "j"]).groupBy("grp", "sample_id").agg(F.sqrt(F.sum((F.col("value") - F.col("c")) ** 2)).alias("d"))
    return d.groupBy("grp").agg(F.avg("d").alias("dispersion"))


def reference_errors(long: DataFrame, reference: DataFrame) -> DataFrame:
    """sample_id, rmse, r, area_error, negative_share against a reference spectrum (j, ref)."""
    x = long.join(reference, "j")
    s = x.groupBy("sample_id").agg(
        F.sqrt(F.avg((F.col("value") - F.col("ref")) ** 2)).alias("rmse"), F.covar_pop("value", "ref").alias("c"), F.stddev_pop("value").alias("a"), F.stddev_pop("ref").alias("b"),
        F.sum("value").alias("area"), F.sum("ref").alias("ref_area"), F.sum(F.when(F.col("value") < 0, -F.col("value")).otherwise(0.0)).alias("neg"), F.sum(F.abs("value")).alias("all"),
    )
    return s.select("sample_id", "rmse", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.col("a") * F.col("b"))).alias("r"), F.when(F.col("ref_area") != 0, F.abs(F.col("area") - F.col("ref_area")) / F.abs("ref_area")).alias("area_error"), F.when(F.col("all") > 0, F.col("neg") / F.col("all")).alias("negative_share"))


def top_jaccard(a: DataFrame, b: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """One row: overlap of the k best keys of two rankings, over their union."""
    top = lambda d: d.orderBy(F.desc(value), key).limit(k).agg(F.collect_set(key).alias("s"))
    both = top(a).withColumnRenamed("s", "x").join(top(b).withColumnRenamed("s", "y"), how="cross")  # one row each
    return both.select((F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def group_direction(long: DataFrame, a, b) -> DataFrame:
    """j, log2 ratio of the groups' medians (b over a) and point-biserial correlation with membership of b."""
    rows = long.where(F.col("grp").isin(a, b)).withColumn("_y", (F.col("grp") == b).cast("double"))
    s = rows.groupBy("j").agg(F.median(F.when(F.col("grp") == a, F.col("value"))).alias("ma"), F.median(F.when(F.col("grp") == b, F.col("value"))).alias("mb"), F.covar_pop("value", "_y").alias("c"), F.stddev_pop("value").alias("s"), F.stddev_pop("_y").alias("t"))
    return s.select("j", F.when((F.col("ma") > 0) & (F.col("mb") > 0), F.log2(F.col("mb") / F.col("ma"))).alias("log2fc"), F.when((F.col("s") > 0) & (F.col("t") > 0), F.col("c") / (F.col("s") * F.col("t"))).alias("r"))


def learning_sizes(df: DataFrame, key: str, label: str, shares: list[float], seed: int = 42) -> DataFrame:
    """(key, share): nested stratified parts of the rows, each holding ceil(share * size) rows of every class."""
    rows = _dealt(df, key, label, seed).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return rows.where(F.col("_r") <= F.ceil(F.col("_n") * F.col("share"))).select(key, "share")

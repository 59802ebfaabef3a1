"""Tables and scores that reports are made of: filters and labels of importance, quality figures, text of shift lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unit_values
from ..plans.matrix import settled, to_long


def vip_filter(vips: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Rows whose ``vip`` reaches the threshold."""
    return vips.where(F.col("vip") >= threshold)


def signed_vip(vips: DataFrame, low: str, high: str, threshold: float = 2.0) -> DataFrame:
    """``vips`` (j, vip, coef) with the importance under its coefficient's sign and the class in which the feature is high."""
    signed = F.col("vip") * F.signum("coef")
    side = F.when(signed >= threshold, f"High in {high}").when(signed <= -threshold, f"High in {low}").otherwise("Under cut off")
    return vips.select("j", signed.alias("signed_vip"), side.alias("direction"))


def loading_vector(long: DataFrame, correlation: DataFrame) -> DataFrame:
    """j, value: the median of each feature under the sign of its correlation (j, corr) with the scores."""
    return long.groupBy("j").agg(F.median("value").alias("m")).join(correlation, "j").select("j", (F.col("m") * F.signum("corr")).alias("value"))


def top_labels(table: DataFrame, n: int, score: str = "neg_log10_p") -> DataFrame:
    """The n changed features (label Up or Down) of largest score, ties to the smaller feature; those without a score get no label."""
    return table.where(F.col("label").isin("Up", "Down") & F.col(score).isNotNull()).orderBy(F.desc(score), "feature").limit(n)


def coefficient_bars(coefs: DataFrame, n: int, order: str = "magnitude") -> DataFrame:
    """The n largest |coef| of (j, coef, low, high) with rank and the bars' lengths below and above; ``order``: magnitude or signed (from the smallest)."""
    if order not in ("magnitude", "signed"):
        raise ValueError("order must be 'magnitude' or 'signed'")
    top = coefs.orderBy(F.desc(F.abs("coef")), "j").limit(n)
    by = [F.desc(F.abs("coef")), F.col("j")] if order == "magnitude" else [F.col("coef"), F.col("j")]
    # At most n rows.
    return top.select(F.row_number().over(Window.orderBy(*by)).cast("long").alias("rank"), "j", "coef", F.abs(F.col("coef") - F.col("low")).alias("below"), F.abs(F.col("high") - F.col("coef")).alias("above"))


def loading_scale(scores: DataFrame, loadings: DataFrame, share: float = 0.7) -> DataFrame:
    """One row: the factor that fits loadings (x, y) into the range of scores (x, y), the smaller of both ratios times ``share``."""
    wide = lambda d, s: d.agg(*[(F.max(c) - F.min(c)).alias(f"{c}{s}") for c in ("x", "y")])
    both = wide(scores, "s").join(wide(loadings, "l"), how="cross")  # one row each
    ratio = lambda c: F.when(F.col(f"{c}l") > 0, F.col(f"{c}s") / F.col(f"{c}l")).otherwise(1.0)
    return both.select((F.least(ratio("x"), ratio("y")) * share).alias("factor"))


def flipped(matrix: DataFrame) -> DataFrame:
    """Samples in order of id with the axis reversed."""
    return matrix.withColumn("values", F.reverse("values")).orderBy("sample_id")


def shift_centre(text: Column) -> Column:
    """First entry of a list of shifts: a number, or the middle of ``low-high``; NULL for anything else."""
    first = F.trim(F.split(text, ",")[0])
    ends = F.split(first, "-")
    span = F.size(ends) == 2
    middle = (ends[0].try_cast("double") + ends[1].try_cast("double")) / 2
    return F.when(first.contains("-") & ~first.startswith("-"), F.when(span, middle)).otherwise(first.try_cast("double"))


def group_tag(text: Column) -> Column:
    """What follows ``Group:`` up to a bar, NULL where there is none."""
    found = F.regexp_extract(text, r"Group:([^|]+)", 1)
    return F.when(found != "", F.trim(found))


def picked_peaks(picks: DataFrame) -> DataFrame:
    """The distinct positions of picked peaks (x), in order."""
    return picks.select("x").where("x IS NOT NULL").distinct().orderBy("x")


def picked_intensities(matrix: DataFrame, features: list[int], names: list[str]) -> DataFrame:
    """sample_id and one column for each picked feature."""
    return matrix.select("sample_id", *[F.get("values", F.lit(j)).alias(n) for j, n in zip(features, names, strict=True)])


#: Samples of a block of ``sample_correlations``, the numbers it holds at most, and the numbers of all pairs of blocks that meet in a task.
SAMPLES, NUMBERS, TASK_NUMBERS = 1_024, 4_000_000, 8_000_000
#: Parts whose pairs are tasks: no more than needed once there are so many. Rows of pairs made at a time.
PARTS, PAIR_ROWS = 128, 1 << 17


def sample_correlations(matrix: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """a, b, r for all pairs a <= b of samples: blocks of unit spectra are multiplied as matrices.

    Blocks are written once, to the checkpoint folder; tasks read pairs of them
    from there, so nothing but the result grows with the square of the samples.
    """
    kind = matrix.schema["sample_id"].dataType.simpleString()
    unit = matrix.select("sample_id", unit_values(F.col("values")).alias("values")).where("values IS NOT NULL AND sample_id IS NOT NULL")
    size = unit.agg(F.count("*").alias("n"), F.max(F.size("values")).alias("p")).first()
    p = max(size["p"] or 1, 1)
    rows = max(1, min(samples, NUMBERS // p))
    blocks = max(1, -(-size["n"] // rows))
    together = max(1, math.isqrt(TASK_NUMBERS // (2 * rows * p)))  # blocks of a part
    parts = max(min(blocks, PARTS), -(-blocks // together))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, most = TaskContext.get().partitionId() << 32, [], rows * 5 // 4  # a part has some more than its share

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            values, ids = t.column("values").combine_chunks(), t.column("sample_id").combine_chunks()
            if pc.any(pc.not_equal(pc.list_value_length(values), p)).as_py():
                raise ValueError("samples have different numbers of features")
            v = np.nan_to_num(pc.fill_null(values.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(float))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([v.tobytes()], pa.binary())], ["k", "ids", "v"])

        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= most:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, most))
                held = t.slice(most).to_batches()
        if any(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x_ids, y_ids = batch.column("x_ids"), batch.column("y_ids")
            for i in range(batch.num_rows):
                own = batch.column("x")[i] == batch.column("y")[i]
                ids = pa.concat_arrays([x_ids[i].values, y_ids[i].values])
                n, m = len(x_ids[i]), len(y_ids[i])
                rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                v, w = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=float).reshape(k, p) for c, k in (("x_v", n), ("y_v", m)))
                step = max(1, PAIR_ROWS // m)
                for at in range(0, n, step):
                    end = min(n, at + step)
                    r = (v[at:end] @ w.T).ravel()
                    a, b = np.repeat(np.arange(at, end), m), n + np.tile(np.arange(m), end - at)
                    swap = rank[a] > rank[b]
                    if own:  # the pair comes the other way round as well
                        keep = np.flatnonzero(~swap)
                        a, b, r = a[keep], b[keep], r[keep]
                    else:
                        a, b = np.where(swap, b, a), np.where(swap, a, b)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(r)], ["a", "b", "r"])

    dealt = unit.repartitionById(parts, F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")).sortWithinPartitions("sample_id")
    packed = settled(dealt.mapInArrow(pack, f"k long, ids array<{kind}>, v binary"))
    x, y = (packed.select(*[F.col(c).alias(n) for c, n in (("k", side), ("ids", f"{side}_ids"), ("v", f"{side}_v"))]) for side in ("x", "y"))
    pairs = x.hint("shuffle_replicate_nl").join(y, F.col("x") <= F.col("y"))  # no shuffle: each task reads its pair of parts
    return pairs.mapInArrow(multiply, f"a {kind}, b {kind}, r double")


def box_whiskers(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """group, n, q1, median, q3, whiskers at the outermost values within ``reach`` interquartile ranges, number of outliers. NULL values are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    q = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.percentile(value, p).alias(c) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    span = reach * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - span, F.col("q3") + span)
    s = rows.join(q, group).groupBy(group).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.sum((~inside).cast("long")).alias("outliers"))
    return q.join(s, group).select(group, "n", "q1", "median", "q3", "low", "high", "outliers")


def named_pairs(df: DataFrame, group: str, order: str) -> DataFrame:
    """group1, group2, name of all pairs of groups in order of first appearance (least ``order``); a slash in a name becomes an underscore."""
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.min(order).alias("o"))
    x, y = (g.select(F.col("g").alias(f"group{i}"), F.col("o").alias(f"o{i}")) for i in (1, 2))
    pairs = x.join(y, (F.col("o1") < F.col("o2")) | ((F.col("o1") == F.col("o2")) & (F.col("group1") < F.col("group2"))))  # groups are few
    return pairs.select("group1", "group2", F.replace(F.concat("group1", F.lit("_vs_"), "group2"), F.lit("/"), F.lit("_")).alias("name"))


def class_rates(df: DataFrame, actual: str, predicted: str, positive) -> DataFrame:
    """One row: balanced accuracy over all classes, sensitivity and specificity of one; NULL where there is nothing to judge."""
    n = df.groupBy(F.col(actual).alias("a")).agg(F.count("*").alias("n"), F.sum((F.col(actual) == F.col(predicted)).cast("long")).alias("hit"), F.sum((F.col(predicted) != positive).cast("long")).alias("other"))
    mine = F.col("a") == positive
    s = n.agg(F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"), *[F.sum(F.when(c, F.col(v))).alias(a) for a, c, v in (("tp", mine, "hit"), ("p", mine, "n"), ("tn", ~mine, "other"), ("q", ~mine, "n"))])
    return s.select("balanced_accuracy", (F.col("tp") / F.col("p")).alias("sensitivity"), (F.col("tn") / F.col("q")).alias("specificity"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """keys, n, r: correlation of average ranks within each key, with at least ``least`` pairs. Pairs of values are counted first, and once: ranks are joined by the values."""
    from .colstats import average_ranks

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = settled(rows.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c")))
    rank = lambda v, r: average_ranks(pairs, keys, v, "_c").select(*keys, v, F.col("rank").alias(r))
    ranked = pairs.join(rank("_x", "_rx"), [*keys, "_x"]).join(rank("_y", "_ry"), [*keys, "_y"]).join(pairs.groupBy(*keys).agg(F.sum("_c").alias("n")), keys)
    c, a, b = F.col("_c"), F.col("_rx") - (F.col("n") + 1) / 2, F.col("_ry") - (F.col("n") + 1) / 2  # the mean of ranks
    s = ranked.groupBy(*keys, "n").agg(F.sum(c * a * b).alias("c"), F.sqrt(F.sum(c * a * a)).alias("a"), F.sqrt(F.sum(c * b * b)).alias("b"))
    return s.where(F.col("n") >= least).select(*keys, "n", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.col("a") * F.col("b"))).alias("r"))


def spectrum_quality(long: DataFrame) -> DataFrame:
    """One row: the share of values below zero, by number."""
    return long.agg(F.avg((F.col("value") < 0).cast("double")).alias("negative_fraction"))


def area_relative_error(areas: DataFrame, eps: float = 1e-12) -> DataFrame:
    """One row: mean of |area - ref| / (|ref| + eps) of (area, ref)."""
    return areas.agg(F.avg(F.abs(F.col("area") - F.col("ref")) / (F.abs("ref") + eps)).alias("area_error"))


def alignment_error(positions: DataFrame, target: float) -> DataFrame:
    """One row: mean distance of peak positions from their target."""
    return positions.agg(F.avg(F.abs(F.col("position") - target)).alias("alignment_error"))


def direction_agreement(df: DataFrame, a: str, b: str, telling: str) -> DataFrame:
    """One row: the share of rows in which two effects have one direction (above zero is up), of all and of the telling ones."""
    same = ((F.col(a) > 0) == (F.col(b) > 0)).cast("double")
    return df.agg(F.avg(same).alias("all_rows"), F.avg(F.when(F.col(telling), same)).alias("telling_rows"))


def run_figures(runs: DataFrame) -> DataFrame:
    """runs (name, items, seconds, baseline_seconds) with throughput and speed-up; no time is infinite speed."""
    rate = lambda x: F.when(F.col("seconds") > 0, F.col(x) / F.col("seconds")).otherwise(float("inf"))
    return runs.select("name", rate("items").alias("throughput"), rate("baseline_seconds").alias("speedup"))


def max_abs_error(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the largest difference of two long forms."""
    both = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys)
    return both.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_error"))

"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspec.catalogue import QUERIES
from lumaspec.operators import normalise, wide
from lumaspec.operators.hypotheses import stocsy
from lumaspec.plans.matrix import to_long

#: Headline queries: tests, column statistics, correlation scan, normalisation, models.
NAMES = ["volcano_welch", "anova_f", "kruskal_h", "padjust_bh", "column_statistics", "feature_preselect_iqr", "stocsy_r", "stocsy_p", "spearman_matrix", "sample_corr_mean", "pqn_a", "snv_msc", "scale_pareto", "median_spectrum", "savgol_interior", "baseline_rubberband", "baseline_asls", "xcorr_shift", "pca_scores", "opls_da", "permutation_p", "reference_errors", "roc_auc_rank"]


#: Shape of the wide study: samples, features.
WIDE = (132, 66_705)


def wide_study(spark: SparkSession) -> DataFrame:
    """A seeded two-class study of few samples with many features; every value comes from a hash of its place."""
    noise = f"transform(sequence(0, {WIDE[1] - 1}), j -> 1 + pmod(xxhash64(sample_id, j), 1000003) / 1000003.0 + pmod(xxhash64(j), 97) / 10.0 + if(j < 2000, grp * 0.4, 0))"
    return spark.range(WIDE[0], numPartitions=8).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("grp")).withColumn("values", F.expr(noise))


def wide_runs(spark: SparkSession) -> dict:
    x = wide_study(spark).persist()
    x.count()
    write = lambda df: df.write.format("noop").mode("overwrite").save()
    return {
        "wide_pca_5": lambda: write(wide.pca(x, 5).loadings),
        "wide_hotelling": lambda: write(wide.pca(x, 5).t2),
        "wide_pqn": lambda: write(normalise.pqn(to_long(x))),
        "wide_stocsy": lambda: write(stocsy(x, 1255)),
        "wide_opls_da_vip_7fold": lambda: write(wide.opls_da(x, 3, 7).features),
    }


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["column_variance"](spark, data).write.format("noop").mode("overwrite").save()  # compiles and starts workers
    times = {}
    for name in NAMES:
        began = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    for name, run in wide_runs(spark).items():
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

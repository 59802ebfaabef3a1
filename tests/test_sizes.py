"""Steps whose work grew faster than their rows."""

import inspect
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumaspec.catalogue import ORACLE_SQL, QUERIES
from lumaspec.operators import hypotheses, latent, reports
from lumaspec.plans.matrix import to_long


def test_f3_harmonic_sum_needs_no_terms(spark):
    sizes = [1, 2, 99, 100, 101, 150, 5_000, 1_200_000]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in sizes], "m long").select(hypotheses.harmonic(F.col("m"))).collect()]
    assert got == pytest.approx([math.fsum(1 / i for i in range(1, m + 1)) for m in sizes], rel=1e-14)
    p = np.random.default_rng(1).random(300) ** 3
    order = np.argsort(p)
    want = np.empty(300)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * 300 * (1 / np.arange(1, 301)).sum() / np.arange(1, 301))[::-1])[::-1])
    rows = hypotheses.adjust(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "feature long, p_value double"), "fdr_by").collect()
    assert {r["feature"]: r["p_adj"] for r in rows} == pytest.approx(dict(enumerate(want)))


@pytest.mark.parametrize("small", [0, 40_000_000])
def test_f2_clusters_of_any_number_of_samples(spark, monkeypatch, small):
    """Tiles, workers and the driver give the tree of the whole distance matrix; equal samples join at height 0; no number of samples is an error unless asked for."""
    monkeypatch.setattr(latent, "SMALL", small)
    monkeypatch.setattr(latent, "TILE", 50)
    x = np.random.default_rng(2).normal(size=(70, 3)) + 6 * (np.arange(70) % 4)[:, None]
    x[40:52] = x[3]
    df = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, grp int, values array<double>").repartition(3)
    ids, rows, flat = latent.hca_samples(df, 5)
    ids2, rows2, flat2 = latent.hca(to_long(df), 5)
    assert ids == ids2 and list(flat) == list(flat2)
    assert [r[2] for r in rows] == pytest.approx([r[2] for r in rows2], abs=1e-6) and rows[-1][3] == 70
    assert [r[2:] for r in rows[:12]] == [(0.0, k) for k in range(2, 14)]
    assert inspect.signature(latent.hca_samples).parameters["most"].default is None


@pytest.mark.parametrize("samples", [4, 1_000])
def test_f11_correlations_by_blocks(spark, samples):
    """Each pair once, within and across blocks; constant spectra have no correlation."""
    x = np.random.default_rng(4).normal(size=(23, 9))
    x[7] = 2.0
    ids = np.random.default_rng(5).permutation(23)
    df = spark.createDataFrame([(f"s{ids[i]:02}", 0, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id string, grp int, values array<double>")
    rows = reports.sample_correlations(df, samples).collect()
    with np.errstate(invalid="ignore"):
        c = np.corrcoef(x)
    want = {tuple(sorted((f"s{ids[i]:02}", f"s{ids[k]:02}"))): c[i, k] for i in range(23) for k in range(i, 23) if 7 not in (i, k)}
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["r"] for r in rows} == pytest.approx(want)


def test_f18_small_negative_values_round_to_negative_zero(spark, tmp_path):
    """As DuckDB rounds: the sign of a zero is kept in the rolled array."""
    v = [-3e-7, 3e-7, 0.0, -0.0, -0.0390625, 0.0390625, -1.5, 2.25] * 8
    spark.createDataFrame([(1, v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["array_roll"](spark, str(tmp_path)).first()["rolled"]
    sql = ORACLE_SQL["array_roll"].replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = duckdb.sql(sql).fetchall()[0][1]
    assert list(map(repr, got)) == list(map(repr, want)) and "-0.0" in map(repr, got)


def test_f19_ranks_of_values_that_change_in_their_last_digits(spark):
    """Aggregates come out with other last digits when they are computed again; no row may fall out of the ranks by that."""

    @F.pandas_udf("double")
    def unsettled(x: pd.Series) -> pd.Series:
        return x * (1 + np.random.default_rng().uniform(-1e-13, 1e-13, len(x)))

    rng = np.random.default_rng(6)
    x, y = rng.permutation(40) + 1.0, rng.permutation(40) + 1.0
    again = unsettled.asNondeterministic()
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double").select("k", again("x").alias("x"), again("y").alias("y"))
    rows = reports.spearman(df, ["k"], "x", "y").collect()
    assert [r["n"] for r in rows] == [40]
    assert rows[0]["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_f19_ranks_of_counted_pairs(spark):
    """Ties and repeated pairs count as rows do."""
    rng = np.random.default_rng(7)
    x, y, k = rng.integers(0, 6, 300), rng.integers(0, 4, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(c), float(a), float(b)) for a, b, c in zip(x, y, k, strict=True)] + [(0, None, 1.0), (1, 1.0, None)], "k int, x double, y double")
    got = {r["k"]: (r["n"], r["r"]) for r in reports.spearman(df, ["k"], "x", "y").collect()}
    for c in (0, 1):
        ranks = [(v[:, None] > v[None, :]).sum(1) + ((v[:, None] == v[None, :]).sum(1) + 1) / 2 for v in (x[k == c], y[k == c])]
        assert got[c] == (int((k == c).sum()), pytest.approx(np.corrcoef(*ranks)[0, 1]))

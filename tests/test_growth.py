"""Work that grew faster than the result."""

import numpy as np
import pytest

from lumaspec.operators import reports


@pytest.mark.parametrize(("samples", "task_numbers"), [(3, 8_000_000), (3, 1), (1_000, 1)])
def test_f2_pairs_of_blocks_without_shuffled_copies(spark, monkeypatch, samples, task_numbers):
    """Blocks are written once; the pairs of them are read, not shuffled."""
    monkeypatch.setattr(reports, "TASK_NUMBERS", task_numbers)
    monkeypatch.setattr(reports, "PARTS", 2)
    monkeypatch.setattr(reports, "PAIR_ROWS", 8)
    x = np.random.default_rng(8).normal(size=(29, 7))
    df = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, grp int, values array<double>").repartition(3)
    found = reports.sample_correlations(df, samples)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    rows = found.collect()
    c = np.corrcoef(x)
    assert len(rows) == 29 * 30 // 2
    assert {(r["a"], r["b"]): r["r"] for r in rows} == pytest.approx({(i, k): c[i, k] for i in range(29) for k in range(i, 29)})


def test_f2_no_samples(spark):
    df = spark.createDataFrame([], "sample_id long, grp int, values array<double>")
    assert reports.sample_correlations(df).collect() == []

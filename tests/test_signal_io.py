"""Signal operators, sources and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.functions import scalars
from lumaspec.operators import joins, signal
from lumaspec.sources import io
from lumaspec.streaming.moments import update_moments
from tests.test_statistics import arrays

X = np.linspace(0, 10, 200)


def peak(at, width=0.1, height=1.0):
    return height * np.exp(-(((X - at) / width) ** 2))


def test_smoothing_keeps_parabolas(spark):
    y = 1 + 2 * X - 0.3 * X**2
    assert np.allclose(signal.savgol_array(y), y)
    got = arrays(spark, [y]).select(signal.savgol(F.col("values")).alias("v")).first()["v"]
    assert np.allclose(got, y)
    short = arrays(spark, [[1, 2, 3]]).select(signal.savgol(F.col("values")).alias("v")).first()["v"]
    assert short == [1, 2, 3]


@pytest.mark.parametrize("method", ["asls", "arpls", "airpls", "modpoly", "imodpoly", "rubberband"])
def test_baselines_recover_a_slope(method):
    y = 2 + 0.1 * X + peak(5, 0.2, 3)
    b = signal.baseline(y, X, method, lam=1e5)
    assert np.abs(b - (2 + 0.1 * X))[(X < 4) | (X > 6)].max() < 0.35
    with pytest.raises(ValueError):
        signal.baseline(y, X, "other")


def test_hull_lies_below():
    y = np.random.default_rng(0).normal(size=50)
    assert (signal.rubberband(np.arange(50.0), y) <= y + 1e-12).all()


def test_whittaker_against_a_dense_solver():
    rng = np.random.default_rng(1)
    y, w = rng.normal(size=20), rng.uniform(0.1, 1, 20)
    d = np.diff(np.eye(20), 2, axis=0)
    assert np.allclose(signal._whittaker(y[None], w[None], 50.0)[0], np.linalg.solve(np.diag(w) + 50 * d.T @ d, w * y))


def test_peaks_and_flat_tops():
    found = signal.find_peaks(np.array([0, 1, 3, 3, 3, 1, 0, 2, 0.0]))
    assert [p for p, _, _ in found] == [3, 7] and found[0][1] == 3


def test_alignment_moves_peaks_together(spark):
    y = [peak(5 + s) for s in (-0.2, 0.0, 0.0, 0.0, 0.2)]
    done, shifts = signal.align(arrays(spark, y), X, [(4.0, 6.0)], 0.5)
    tops = [X[int(np.argmax(r["values"]))] for r in done.collect()]
    assert max(tops) - min(tops) < 0.06
    moved, _ = signal.align(arrays(spark, y), X, [(6.0, 4.0)], 0.5, mode="as_published")
    tops = [X[int(np.argmax(r["values"]))] for r in moved.collect()]
    assert max(tops) - min(tops) > 0.3
    assert {r["shift"] for r in signal.align(arrays(spark, y), X, [(4.0, 4.1)])[1].collect()} == {0}


def test_calibration(spark):
    got = signal.calibrate(arrays(spark, [peak(2.1)]), X, "acetate", (1.5, 2.5)).first()["values"]
    assert X[int(np.argmax(got))] == pytest.approx(1.91, abs=0.06)


def test_multiplets_and_windows(spark):
    y = arrays(spark, [peak(2.0, 0.3) + peak(3.0, 0.3) + peak(7.0, 0.3, 2)])
    rows = signal.multiplets(y, X, 0.2, 0.5, 1.2).orderBy("start").collect()
    assert [r["pattern"] for r in rows] == ["doublet", "singlet"]
    assert signal.auto_windows(y, X).count() >= 1


def test_signal_to_spectrum():
    t = np.arange(512)
    fid = np.exp(2j * np.pi * 0.1 * t - t / 60) * np.exp(1j * 0.7)
    y = signal.process_fid(fid.real, fid.imag, 1024)
    assert y.max() > 5 * abs(y.min())


def test_fid_source(spark, tmp_path):
    for name in ("s2", "s1"):
        d = tmp_path / "run" / name
        d.mkdir(parents=True)
        (d / "fid").write_bytes(np.array([1, 2, 3, 4], dtype=">i4").tobytes())
        (d / "acqus").write_text("##$BYTORDA= 1\n##$DTYPA= 0\n##$SW= 20\n$$ note\n##END=\n")
    got = io.read_fids(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in got] == ["s1", "s2"] and got[0]["re"] == [1, 3] and got[0]["im"] == [2, 4] and got[0]["parameters"]["SW"] == "20"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x").write_text("")
    with pytest.raises(FileNotFoundError):
        io.read_fids(spark, str(tmp_path / "none"))


def test_bucket_tables_and_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("code,1.0_1.2,0.8_1.0,note\na,3,4,x\nb,,6,y\n")
    long, axis = io.read_buckets(spark, str(tmp_path / "b.csv"), "code")
    assert [(r["coord"]) for r in axis.orderBy("j").collect()] == [0.9, 1.1]
    assert {(r["sample_id"], r["j"]): r["value"] for r in long.collect()} == {("a", 0): 4, ("a", 1): 3, ("b", 0): 6, ("b", 1): None}
    io.write_csv(spark.createDataFrame([("=1+1", "p")], "t string, pair string"), str(tmp_path / "o"), "pair")
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first()["t"] == "'=1+1"
    assert io.output_path("o", "vip", "a", "b") == "o/vip/pair=a_vs_b"


def test_annotations_round_trip(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "<b>"), (1, 3.0, 4.0, "ok")], "sample_id long, x double, y double, text string")
    back = io.annotations_from_json(io.annotations_to_json(df)).orderBy("x").collect()
    assert [r["x"] for r in back] == [1.0, 3.0] and back[0]["text"].startswith("&amp;lt;b")
    bad = spark.createDataFrame([(1, '[{"x": 1, "text": "no y"}, {"x": 1, "y": 2, "text": "k"}]')], "sample_id long, json string")
    assert io.annotations_from_json(bad).count() == 1


def test_text_guards(spark):
    df = spark.createDataFrame([("  <script>'&\"  ",), ("=cmd",), (None,)], "t string")
    rows = [r[0] for r in df.select(scalars.html_text(F.col("t"))).collect()]
    assert rows[0] == "&lt;script&gt;&#x27;&amp;&quot;" and rows[2] is None
    assert [r[0] for r in df.select(scalars.csv_text(F.col("t"))).collect()][1:] == ["'=cmd", None]


def test_cut_region_reversed_removes_nothing(spark):
    from lumaspec.plans.matrix import to_long

    axis = spark.createDataFrame([(j, float(j)) for j in range(5)], "j long, coord double")
    long = to_long(arrays(spark, [[0, 1, 2, 3, 4]]))
    assert sorted(r["value"] for r in joins.cut_region(long, axis, 1, 2).collect()) == [0, 3, 4]
    assert joins.cut_region(long, axis, 2, 1).count() == 5


def test_streamed_moments(spark, tmp_path):
    state = str(tmp_path / "state")
    for part in ([[1.0, 2.0]], [[3.0, 6.0], [5.0, 1.0]]):
        update_moments(arrays(spark, part), state)
    from lumaspec.streaming.moments import current_moments

    got = {r["j"]: r for r in current_moments(spark, state).collect()}
    assert got[0]["n"] == 3 and got[0]["mean"] == pytest.approx(3) and got[1]["m2"] == pytest.approx(np.var([2, 6, 1]) * 3)


def test_prominences_against_a_plain_scan():
    rng = np.random.default_rng(7)
    for y in [rng.integers(0, 6, 60).astype(float) for _ in range(60)] + [rng.normal(size=200), np.arange(9.0), np.zeros(5), np.array([1.0])]:
        want = []
        for i in range(1, len(y) - 1):
            k = i
            while k < len(y) - 1 and y[k + 1] == y[i]:
                k += 1
            if y[i - 1] < y[i] and k < len(y) - 1 and y[k + 1] < y[i]:
                p = (i + k) // 2
                a = max([q + 1 for q in range(p) if y[q] > y[p]], default=0)
                b = min([q for q in range(p, len(y)) if y[q] > y[p]], default=len(y))
                want.append((p, y[p] - max(y[a : p + 1].min(), y[p:b].min())))
        got = [(p, h) for p, h, _ in signal.find_peaks(y)]
        assert [p for p, _ in got] == [p for p, _ in want] and np.allclose([h for _, h in got], [h for _, h in want])

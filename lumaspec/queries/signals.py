"""Signal operators over the spectra in ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signal as g
from . import query
from .columns import LONG, matrix, r6
from .joins_text import AXIS_SQL, axis

AXIS = 9.5 - 9.0 * np.arange(64) / 63


def _filter_sql() -> str:
    c = g.savgol_coefficients()[5]
    terms = " + ".join(f"{float(k)!r} * {'lag' if i < 5 else 'lead'}(value, {abs(i - 5)}) OVER w" for i, k in enumerate(c) if i != 5)
    return f"SELECT sample_id, j, round(v, 6) + 0.0 AS value FROM (SELECT sample_id, j, {terms} + {float(c[5])!r} * value AS v FROM {LONG} l WINDOW w AS (PARTITION BY sample_id ORDER BY j)) WHERE j BETWEEN 5 AND 58"


@query(_filter_sql())
def savgol_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).select("sample_id", F.posexplode(g.savgol(F.col("values"))).alias("j", "value"))
    return rows.where("j BETWEEN 5 AND 58").select("sample_id", F.col("j").cast("long").alias("j"), *r6("value"))


def _edges_sql() -> str:
    c = g.savgol_coefficients()
    row = lambda i: "[" + ", ".join(repr(float(k)) for k in c[i]) + "]"
    v = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
    case = " ".join(f"WHEN {j} THEN list_dot_product({row(i)}, v[{a}:{a + 10}])" for j, i, a in [*((j, j, 1) for j in range(5)), *((j, j - 53, 54) for j in range(59, 64))])
    return f"SELECT sample_id, j, round(CASE j {case} ELSE list_dot_product({row(5)}, v[j - 4:j + 6]) END, 6) + 0.0 AS value FROM (SELECT vec_id AS sample_id, {v} AS v, CAST(unnest(range(64)) AS BIGINT) AS j FROM embeddings)"


@query(_edges_sql())
def savgol_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole spectra, ends by the polynomials of the first and last windows."""
    rows = matrix(spark, sf_dir).select("sample_id", F.posexplode(g.savgol(F.col("values"))).alias("j", "value"))
    return rows.select("sample_id", F.col("j").cast("long").alias("j"), *r6("value"))


@query(f"SELECT sample_id, round(arg_max(coord, (value, -j)), 9) AS position FROM {LONG} l JOIN {AXIS_SQL} a USING (j) WHERE coord BETWEEN 4.0 AND 6.0 GROUP BY sample_id")
def calibrate_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.peak_positions(matrix(spark, sf_dir), axis(spark), 4.0, 6.0).select("sample_id", F.round("position", 9).alias("position"))


@query(f"""WITH l AS {LONG}, r AS (SELECT j, median(value) AS ref FROM l GROUP BY j), c AS (SELECT j, ref - avg(ref) OVER () AS ref FROM r),
q AS (SELECT sample_id, j, value - avg(value) OVER (PARTITION BY sample_id) AS v FROM l),
x AS (SELECT q.sample_id, s, sum(ref * v) AS score FROM c, range(-3, 4) t(s) JOIN q ON q.j = c.j + s GROUP BY ALL)
SELECT sample_id, CAST(arg_max(s, (round(score, 12), -s)) AS BIGINT) AS shift FROM x GROUP BY sample_id""")
def xcorr_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = 9.0 / 63
    _, shifts = g.align(matrix(spark, sf_dir), AXIS, [(0.0, 10.0)], 3 * step)
    return shifts.select("sample_id", F.col("shift").cast("long").alias("shift"))


@query(f"""WITH l AS {LONG}, win AS (SELECT w, j, row_number() OVER (PARTITION BY w ORDER BY j) - 1 AS i, count(*) OVER (PARTITION BY w) AS n FROM {AXIS_SQL} a JOIN (VALUES (0, 1.0, 4.0), (1, 5.0, 9.0)) v(w, low, high) ON coord BETWEEN low AND high),
c AS (SELECT w, i, n, ref - avg(ref) OVER (PARTITION BY w) AS t FROM win JOIN (SELECT j, median(value) AS ref FROM l GROUP BY j) USING (j)),
q AS (SELECT sample_id, w, i, value, value - avg(value) OVER (PARTITION BY sample_id, w) AS v FROM l JOIN win USING (j)),
x AS (SELECT sample_id, c.w, s, sum(t * v) AS score FROM c, range(-4, 5) r(s) JOIN q ON q.w = c.w AND q.i = c.i + s GROUP BY ALL),
b AS (SELECT sample_id, w, arg_max(s, (round(score, 12), -s)) AS s FROM x GROUP BY ALL)
SELECT l.sample_id, l.j, round(coalesce(q.value, l.value), 6) + 0.0 AS value FROM l LEFT JOIN win ON win.j = l.j LEFT JOIN b ON b.sample_id = l.sample_id AND b.w = win.w
LEFT JOIN q ON q.sample_id = l.sample_id AND q.w = win.w AND q.i = (win.i + b.s + win.n) % win.n""")
def aligned_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.align(matrix(spark, sf_dir), AXIS, [(1.0, 4.0), (5.0, 9.0)], 0.5)[0].select("sample_id", F.posexplode("values").alias("j", "value"))
    return rows.select("sample_id", F.col("j").cast("long").alias("j"), *r6("value"))


def _calibrated_sql(low: float, high: float, goal: float, at: str) -> str:
    """``at``: the peak's coordinate over rows (coord, value, j) of a range."""
    return f"""WITH l AS {LONG}, r AS (SELECT sample_id, {at} AS peak FROM l JOIN {AXIS_SQL} a USING (j) WHERE coord BETWEEN {low} AND {high} GROUP BY sample_id),
q AS (SELECT l.sample_id, l.j, greatest(0.0, least(63.0, (9.5 - (coord + peak - {goal})) * 7.0)) AS p FROM l JOIN {AXIS_SQL} a USING (j) JOIN r USING (sample_id))
SELECT q.sample_id, q.j, round(x.value + (p - x.j) * (y.value - x.value), 5) + 0.0 AS value FROM q JOIN l x ON x.sample_id = q.sample_id AND x.j = least(62, floor(p)) JOIN l y ON y.sample_id = q.sample_id AND y.j = x.j + 1"""


def _calibrated(spark: SparkSession, sf_dir: str, *how) -> DataFrame:
    rows = g.calibrate(matrix(spark, sf_dir), AXIS, *how).select("sample_id", F.posexplode("values").alias("j", "value"))
    return rows.select("sample_id", F.col("j").cast("long").alias("j"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


SINGLET = "arg_max(coord, (value, -j))"
#: In a range of three points the only peak is the middle one.
MIDDLE = "CASE WHEN arg_min(value, abs(j - mid)) - greatest(arg_min(value, j), arg_max(value, j)) >= 0.01 THEN arg_min(coord, abs(j - mid)) ELSE arg_max(coord, (value, -j)) END"


@query(_calibrated_sql(1.8, 2.2, 1.91, SINGLET))
def calibrated_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "acetate")


@query(_calibrated_sql(8.0, 8.4, 8.44, SINGLET))
def calibrated_formate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "formate")


@query(_calibrated_sql(5.0, 5.4, 5.23, MIDDLE.replace("mid", "30")))
def calibrated_glucose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "glucose")


@query(_calibrated_sql(1.2, 1.6, 1.48, MIDDLE.replace("mid", "57")))
def calibrated_alanine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "alanine")


@query(_calibrated_sql(3.0, 4.0, 3.5, SINGLET))
def calibrated_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range alone: its middle is the target."""
    return _calibrated(spark, sf_dir, "own", (3.0, 4.0))


@query(f"""SELECT round(avg(abs(position - 5.0)), 6) AS alignment_error FROM (SELECT arg_max(coord, (value, -j)) AS position FROM {LONG} l JOIN {AXIS_SQL} a USING (j) WHERE coord BETWEEN 4.0 AND 6.0 GROUP BY sample_id)""")
def alignment_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reports import alignment_error

    return alignment_error(g.peak_positions(matrix(spark, sf_dir), axis(spark), 4.0, 6.0), 5.0).select(*r6("alignment_error"))


@query()
def baseline_asls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.baseline_correct(matrix(spark, sf_dir), "asls", lam=1e4)


@query(f"""WITH l AS {LONG} SELECT x.sample_id, x.j, round(x.value - least(x.value, coalesce(min(a.value + (b.value - a.value) * (x.j - a.j) / (b.j - a.j)), x.value)), 5) + 0.0 AS value
FROM l x LEFT JOIN l a ON a.sample_id = x.sample_id AND a.j < x.j LEFT JOIN l b ON b.sample_id = x.sample_id AND b.j > x.j GROUP BY x.sample_id, x.j, x.value""")
def baseline_rubberband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower hull at a point is the lowest chord over it."""
    rows = g.baseline_correct(matrix(spark, sf_dir), "rubberband").select("sample_id", F.posexplode("values").alias("j", "value"))
    return rows.select("sample_id", F.col("j").cast("long").alias("j"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query()
def multiplet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.multiplets(matrix(spark, sf_dir), AXIS, 0.01, 1.0, 0.3)

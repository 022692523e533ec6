"""Registered queries: per-curve operators, features, long traces."""

from pyspark.sql import functions as F

from curvecal.constants import FEATURES, ROI_WINDOWS
from curvecal.functions import arrays as A
from curvecal.functions.features import extract, extract_windows, roi_cut, with_flags
from curvecal.operators import traces
from curvecal.operators.baseline import baseline_subtract
from curvecal.plans import sqltext as Q
from curvecal.plans.catalog_sources import flagged_sql
from curvecal.plans.registry import query, r6
from curvecal.sources import adapters as AD

GRID = AD.GRID
WINDOW = f"WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629)}"
SHAPES = f"{WINDOW}, {Q.features()}"


def moved(spark, folder):
    return baseline_subtract(AD.curves(spark, folder), GRID)


def smooth_window(spark, folder):
    """Smoothed window of each curve, bound once per row."""
    pot, cur = roi_cut(F.col("cur"), GRID)
    return moved(spark, folder).select("sample_id", A.boxcar(cur).alias("ys")), pot


def shape_query(name, columns, build):
    """Register a query of some features computed by ``build(pot, ys)`` alone."""
    @query(name, SHAPES + "SELECT sample_id, "
           + ", ".join(f'{r6(chr(34) + c + chr(34))} AS "{c}"' for c in columns) + " FROM f")
    def run(spark, folder):
        rows, pot = smooth_window(spark, folder)
        made = A.let(F.col("ys"), lambda ys: F.struct(
            *[c.alias(n) for n, c in zip(columns, build(pot, ys))]))
        return rows.select("sample_id", made.alias("m")).select("sample_id", *[f"m.{c}" for c in columns])


@query("curve_smooth", WINDOW + f"SELECT sample_id, CAST(j AS INT) AS j, {r6('y')} AS i FROM w")
def curve_smooth(spark, folder):
    rows, _ = smooth_window(spark, folder)
    return rows.select("sample_id", F.posexplode("ys").alias("j", "i"))


def at_peak(build):
    return lambda pot, ys: [A.let(A.peak_index(ys), lambda k: build(pot, ys, k))]


shape_query("curve_area", ["Area_peak"], lambda pot, ys: [A.trapezoid(pot, A.clip_low(ys))])
shape_query("curve_fwhm", ["FWHM"], at_peak(A.fwhm_at))
shape_query("curve_peak", ["Ip_corr", "Ep"], lambda pot, ys: [A.peak(pot, ys)[c] for c in ("Ip_corr", "Ep")])
shape_query("curve_peak_to_bg", ["Peak_to_bg"], lambda pot, ys: [A.let(
    A.background_mean(ys), lambda b: A.peak_to_background(F.array_max(ys), b))])
shape_query("curve_slopes", ["Slope_rise", "Slope_fall"],
            lambda pot, ys: at_peak(A.rise_slope)(pot, ys) + at_peak(A.fall_slope)(pot, ys))
shape_query("curve_symmetry", ["Symmetry"], at_peak(lambda pot, ys, k: A.let_many(
    [A.rise_slope(pot, ys, k), A.fall_slope(pot, ys, k)], A.symmetry)))
shape_query("curve_d1_max", ["dIdE_max"], lambda pot, ys: [A.finite_max(A.gradient(pot, ys))])
shape_query("curve_d2_max", ["d2IdE2_max"],
            lambda pot, ys: [A.finite_max(A.gradient(pot, A.gradient(pot, ys)))])
shape_query("curve_moments", ["Mean", "Var", "Skew", "Kurtosis"],
            lambda pot, ys: [A.moments(ys)[c] for c in ("Mean", "Var", "Skew", "Kurtosis")])
shape_query("curve_energy", ["Energy"], lambda pot, ys: [A.energy(ys)])


@query("curve_slope", WINDOW + f"SELECT sample_id, {r6('regr_slope(y, e)')} AS slope FROM w GROUP BY sample_id")
def curve_slope(spark, folder):
    rows, pot = smooth_window(spark, folder)
    return rows.select("sample_id", A.line_slope(pot, F.col("ys")).alias("slope"))


PLAIN = ", ".join(f'{r6(chr(34) + c + chr(34))} AS "{c}"' for c in FEATURES)


@query("feature_extract", SHAPES + f"SELECT sample_id, {PLAIN} FROM f")
def feature_extract(spark, folder):
    return extract(moved(spark, folder), ["sample_id"], GRID)


@query("feature_extract_columns", SHAPES + f"SELECT sample_id, {PLAIN} FROM f")
def feature_extract_columns(spark, folder):
    """The same features as pure Column expressions."""
    return extract(moved(spark, folder), ["sample_id"], GRID, bulk=False)


@query("feature_extract_ragged", SHAPES + f"SELECT sample_id, {PLAIN} FROM f")
def feature_extract_ragged(spark, folder):
    """The same features for curves that carry their own grid."""
    return extract(AD.with_pot(moved(spark, folder)), ["sample_id"], None)


@query("feature_flags", SHAPES + f"SELECT sample_id, {r6('ppb')} AS concentration_ppb, {flagged_sql()} FROM f")
def feature_flags(spark, folder):
    meta = ["sample_id", "concentration_ppb"]
    return with_flags(extract(moved(spark, folder), meta, GRID), meta)


def roi_sql():
    ctes, selects = [], []
    for name, (low, high) in ROI_WINDOWS.items():
        w, f = f"w{name.lower()}", f"f{name.lower()}"
        ctes += [Q.window_points(low, high, 5, w), Q.features(w, f)]
        selects.append(f"SELECT '{name}' AS roi, sample_id, {flagged_sql()} FROM {f}")
    return f"WITH {Q.CURVES}, {', '.join(ctes)} " + " UNION ALL ".join(selects)


@query("feature_extract_roi", roi_sql())
def feature_extract_roi(spark, folder):
    shapes = extract_windows(moved(spark, folder), ["sample_id"], GRID, ROI_WINDOWS)
    return with_flags(shapes, ["roi", "sample_id"])


@query("feature_extract_unsmoothed", f"""
WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629, None)}, {Q.features()} SELECT sample_id, {PLAIN} FROM f""")
def feature_extract_unsmoothed(spark, folder):
    return extract(moved(spark, folder), ["sample_id"], GRID, window=0)


NEAR = f"""
WITH {Q.TRACES}, nb AS (SELECT *, lag(e) OVER o AS e0, lag(i) OVER o AS i0, lead(e) OVER o AS e2, lead(i) OVER o AS i2
  FROM tr WINDOW o AS (PARTITION BY sample_id ORDER BY e, row_id))
"""


@query("trace_area", NEAR + f"""
SELECT sample_id, {r6('sum((e - e0) * (greatest(i, 0) + greatest(i0, 0)) / 2) / 1000000')} AS area_mega, count(*) AS n
FROM nb GROUP BY sample_id""")
def trace_area(spark, folder):
    return traces.trace_area(AD.traces(spark, folder)).select(
        "sample_id", (F.col("area") / 1_000_000).alias("area_mega"), "n")


@query("trace_slope", f"""
WITH {Q.TRACES} SELECT sample_id, {r6('regr_slope(i, e) * 1000000')} AS slope_micro, count(*) AS n
FROM tr GROUP BY sample_id""")
def trace_slope(spark, folder):
    return traces.trace_slope(AD.traces(spark, folder)).select(
        "sample_id", (F.col("slope") * 1_000_000).alias("slope_micro"), "n")


@query("trace_d1_max", NEAR + f"""
SELECT sample_id, {r6('''max(CASE WHEN e0 IS NULL THEN (i2 - i) / (e2 - e) WHEN e2 IS NULL THEN (i - i0) / (e - e0)
  ELSE ((i - i0) * (e2 - e) / (e - e0) + (i2 - i) * (e - e0) / (e2 - e)) / (e2 - e0) END)''')} AS d1_max
FROM nb GROUP BY sample_id""")
def trace_d1_max(spark, folder):
    return traces.trace_d1_max(AD.traces(spark, folder))

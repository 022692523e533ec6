"""Curve operators on closed-form curves, and the two feature forms against each other."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curvecal.constants import FEATURES
from curvecal.functions import arrays as A
from curvecal.functions.features import extract, extract_windows, feature_matrix, roi_span, with_flags
from curvecal.sources.adapters import GRID

FIRST, COUNT = roi_span(GRID)
ROI = np.array(GRID[FIRST:FIRST + COUNT])


def curve(values):
    """A full-grid curve with ``values`` in the window."""
    full = [0.0] * len(GRID)
    full[FIRST:FIRST + COUNT] = [float(v) for v in values]
    return full


CURVES = {
    "flat": np.zeros(COUNT),
    "ramp": 1 + 2 * np.arange(COUNT) / 24,
    "triangle": 12.0 - np.abs(np.arange(COUNT) - 12.0),
    "negative": -np.ones(COUNT),
    "spike_end": np.r_[np.zeros(COUNT - 1), 1.0],
    "with_nan": np.r_[np.ones(12), np.nan, np.ones(12)],
    "two_peaks": np.r_[np.zeros(5), 3.0, np.zeros(6), 3.0, np.zeros(12)],
    "gauss": 5 * np.exp(-((ROI + 0.19) / 0.03) ** 2) + 0.5,
}


def table(spark, curves):
    rows = [(name, curve(v)) for name, v in curves.items()]
    return spark.createDataFrame(rows, "sample_id string, cur array<double>")


def collect(df):
    return {r["sample_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def smooth(spark):
    return collect(with_flags(extract(table(spark, CURVES), ["sample_id"], GRID, bulk=False), ["sample_id"]))


@pytest.fixture(scope="module")
def rough(spark):
    return collect(with_flags(extract(table(spark, CURVES), ["sample_id"], GRID, window=0, bulk=False),
                              ["sample_id"]))


def test_flat(smooth):
    row = smooth["flat"]
    assert row["Ip_corr"] == 0 and row["Ep"] == ROI[0]
    assert row["Peak_to_bg"] == 0.0 and row["Peak_to_bg_valid"] == 0 and row["FWHM_valid"] == 0
    assert math.isnan(row["Skew"]) and math.isnan(row["Slope_rise"])


def test_ramp_peaks_two_points_before_the_edge(smooth):
    row = smooth["ramp"]
    assert row["Ep"] == ROI[22]
    assert row["FWHM"] == 0.0 and row["FWHM_valid"] == 0


def test_triangle(rough):
    row = rough["triangle"]
    step = np.diff(ROI).mean()
    assert row["FWHM"] == pytest.approx(12 * step, rel=1e-3)
    assert row["Symmetry"] == pytest.approx(-1.0, rel=1e-3)
    assert row["Area_peak"] == pytest.approx(144 * step, rel=1e-3)


def test_negative(smooth):
    row = smooth["negative"]
    assert row["Ip_corr"] == pytest.approx(-0.6) and row["Ep"] == ROI[0]
    assert math.isnan(row["Slope_rise"]) and row["FWHM_valid"] == 0 and row["Area_peak"] == 0


def test_spike_at_the_end_has_no_fall(rough):
    row = rough["spike_end"]
    assert row["Slope_fall"] == 0.0 and row["Slope_fall_valid"] == 0 and row["Symmetry_valid"] == 0


def test_nan_is_the_peak(smooth):
    row = smooth["with_nan"]
    assert math.isnan(row["Ip_corr"]) and row["Ep"] == ROI[10] and row["FWHM_valid"] == 0
    assert math.isfinite(row["dIdE_max"])


def test_first_of_equal_peaks_wins(rough):
    assert rough["two_peaks"]["Ep"] == ROI[5]


def test_energy_invariant(smooth):
    for row in smooth.values():
        if not math.isnan(row["Energy"]):
            assert row["Energy"] == pytest.approx(COUNT * (row["Var"] + row["Mean"] ** 2), abs=1e-12)


def test_short_curves_are_blank(spark):
    df = spark.createDataFrame([("s", [-0.2, -0.1, -0.09, -0.08], [1.0, 2.0, 3.0, 1.0])],
                               "sample_id string, pot array<double>, cur array<double>")
    row = with_flags(extract(df, ["sample_id"], None), ["sample_id"]).first()
    assert math.isnan(row["Ip_corr"]) and row["FWHM"] == 0.0
    assert [row[f"{c}_valid"] for c in ("FWHM", "Slope_fall", "Symmetry", "Peak_to_bg")] == [0, 0, 0, 0]


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-11)


@pytest.mark.parametrize("window", [0, 5, 7])
def test_blocks_equal_columns(spark, window):
    rng = np.random.default_rng(3)
    curves = dict(CURVES, **{f"r{k}": rng.normal(size=COUNT) for k in range(40)})
    df = table(spark, curves)
    a = collect(extract(df, ["sample_id"], GRID, window=window, bulk=False))
    b = collect(extract(df, ["sample_id"], GRID, window=window))
    ragged = collect(extract(df.withColumn("pot", F.lit(GRID)), ["sample_id"], None, window=window))
    for name in curves:
        for f in FEATURES:
            assert same(a[name][f], b[name][f]), (name, f)
            assert same(a[name][f], ragged[name][f]), (name, f)


def test_numpy_definitions(spark):
    """Block features against numpy's own gradient, least squares, trapezoid and moments."""
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(30, COUNT))
    got = feature_matrix(ROI, raw)
    for y, row in zip(raw, got):
        s = np.convolve(y, np.ones(5) / 5, mode="same")
        k = int(np.argmax(s))
        d1 = np.gradient(s, ROI)
        want = {
            "Ip_corr": s[k], "Ep": ROI[k], "Area_peak": np.trapezoid(np.clip(s, 0, None), ROI),
            "Slope_rise": np.polyfit(ROI[:k + 1], s[:k + 1], 1)[0] if k else np.nan,
            "Slope_fall": np.polyfit(ROI[k:], s[k:], 1)[0] if k < COUNT - 1 else np.nan,
            "dIdE_max": d1.max(), "d2IdE2_max": np.gradient(d1, ROI).max(),
            "Mean": s.mean(), "Var": s.var(), "Energy": (s ** 2).sum()}
        for name, value in want.items():
            assert row[FEATURES.index(name)] == pytest.approx(value, rel=1e-8, nan_ok=True), name


@settings(max_examples=20, deadline=None)
@given(st.floats(0.5, 50), st.integers(0, 1000))
def test_scaling(c, seed):
    raw = np.random.default_rng(seed).normal(size=(4, COUNT)) + 1.0
    a, b = feature_matrix(ROI, raw), feature_matrix(ROI, c * raw)
    for name in ("Ip_corr", "Area_peak", "Mean", "Slope_rise", "dIdE_max"):
        j = FEATURES.index(name)
        np.testing.assert_allclose(b[:, j], c * a[:, j], rtol=1e-9)
    for name in ("Ep", "FWHM", "Symmetry"):
        j = FEATURES.index(name)
        np.testing.assert_allclose(b[:, j], a[:, j], rtol=1e-7)


def test_windows_in_one_pass(spark):
    df = table(spark, CURVES)
    both = extract_windows(df, ["sample_id"], GRID, {"A": (-0.3078, -0.0629), "C": (-0.3385, -0.0526)})
    for name, (low, high) in {"A": (-0.3078, -0.0629), "C": (-0.3385, -0.0526)}.items():
        one = collect(extract(df, ["sample_id"], GRID, low, high))
        got = collect(both.where(F.col("roi") == name))
        assert all(same(one[s][f], got[s][f]) for s in one for f in FEATURES)


def test_smoothing_longer_than_the_curve_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "cur array<double>")
    with pytest.raises(Exception, match="shorter than the smoothing window"):
        df.select(A.boxcar(F.col("cur"), 5)).collect()
    with pytest.raises(ValueError):
        roi_span(GRID, -0.2, -0.19)

"""The fifteen peak-shape features of a curve, as one expression or in Arrow blocks.

Both forms give the same numbers. ``feature_struct`` stays inside the JVM and works
for curves with their own grids. ``extract_blocks`` needs one grid for all curves and
evaluates whole Arrow batches as matrices; it is the faster form for bulk extraction.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.constants import (
    EPS, FEATURES, FLAGGED, MIN_ROI_POINTS, ROI_HIGH_V, ROI_LOW_V, SMOOTH_WINDOW,
)
from curvecal.functions import arrays as A


def roi_span(grid: list[float], low: float = ROI_LOW_V, high: float = ROI_HIGH_V) -> tuple[int, int]:
    """(first index, count) of the closed window on an ascending grid."""
    inside = [k for k, e in enumerate(grid) if low <= e <= high]
    if len(inside) < MIN_ROI_POINTS:
        raise ValueError(
            f"window [{low}, {high}] holds {len(inside)} grid points, needs {MIN_ROI_POINTS}")
    return inside[0], len(inside)


def roi_cut(cur: Column, grid: list[float], low: float = ROI_LOW_V,
            high: float = ROI_HIGH_V) -> tuple[Column, Column]:
    """(pot, cur) of the window when all curves share ``grid``."""
    first, count = roi_span(grid, low, high)
    return F.lit(grid[first:first + count]), F.slice(cur, first + 1, count)


def roi_cut_ragged(pot: Column, cur: Column, low: float = ROI_LOW_V,
                   high: float = ROI_HIGH_V) -> tuple[Column, Column]:
    """(pot, cur) of the window when every curve carries its own grid."""
    pairs = F.filter(F.arrays_zip(pot.alias("e"), cur.alias("y")),
                     lambda p: p["e"].between(low, high))
    return F.transform(pairs, lambda p: p["e"]), F.transform(pairs, lambda p: p["y"])


def feature_struct(pot: Column, cur: Column, window=SMOOTH_WINDOW) -> Column:
    """Struct of all features from a window; all NaN below five points."""
    blank = F.struct(*[A.nan().alias(name) for name in FEATURES])

    def derive(es, ys, k, grad):
        second = A.gradient(es, grad)

        def collect(rise, fall, m, d2):
            values = {
                "Ip_corr": F.get(ys, k),
                "Ep": F.get(es, k),
                "Area_peak": A.trapezoid(es, A.clip_low(ys)),
                "FWHM": A.fwhm_at(es, ys, k),
                "Peak_to_bg": A.let(A.background_mean(ys),
                                    lambda b: A.peak_to_background(F.get(ys, k), b)),
                "Slope_rise": rise,
                "Slope_fall": fall,
                "Symmetry": A.symmetry(rise, fall),
                "dIdE_max": A.finite_max(grad),
                "d2IdE2_max": A.finite_max(d2),
                "Mean": m["Mean"], "Var": m["Var"], "Skew": m["Skew"], "Kurtosis": m["Kurtosis"],
                "Energy": A.energy(ys),
            }
            return F.struct(*[values[name].alias(name) for name in FEATURES])
        return A.let_many(
            [A.rise_slope(es, ys, k), A.fall_slope(es, ys, k), A.moments(ys), second], collect)

    def smoothed(es, ys):
        return A.let_many([A.peak_index(ys), A.gradient(es, ys)],
                          lambda k, grad: derive(es, ys, k, grad))

    def whole(es, raw):
        return F.when(F.size(raw) < MIN_ROI_POINTS, blank).otherwise(
            A.let(A.boxcar(raw, window), lambda ys: smoothed(es, ys)))
    return A.let_many([pot, cur], whole)


def flag_columns(feature) -> list[Column]:
    """Features with undefined peak shapes set to 0 and marked; ``feature(name)`` reads one."""
    out = []
    for name in FEATURES:
        value = feature(name)
        if name in FLAGGED:
            value = F.when(A.is_finite(value), value).otherwise(F.lit(0.0))
        out.append(value.alias(name))
    for name in FLAGGED:
        out.append(F.when(A.is_finite(feature(name)), 1).otherwise(0).cast("int").alias(f"{name}_valid"))
    return out


def extract(df: DataFrame, meta: list[str], grid: list[float] | None, low: float = ROI_LOW_V,
            high: float = ROI_HIGH_V, window=SMOOTH_WINDOW, bulk: bool = True) -> DataFrame:
    """Feature table from curve rows; ``grid=None`` reads each row's own ``pot``."""
    if grid is None:
        pot, cur = roi_cut_ragged(F.col("pot"), F.col("cur"), low, high)
    elif bulk:
        return extract_blocks(df, meta, grid, low, high, window)
    else:
        pot, cur = roi_cut(F.col("cur"), grid, low, high)
    rows = df.select(*meta, feature_struct(pot, cur, window).alias("shape"))
    return rows.select(*meta, *[F.col(f"shape.{name}").alias(name) for name in FEATURES])


def with_flags(features: DataFrame, meta: list[str]) -> DataFrame:
    return features.select(*meta, *flag_columns(F.col))


def extract_blocks(df: DataFrame, meta: list[str], grid: list[float], low: float, high: float,
                   window=SMOOTH_WINDOW) -> DataFrame:
    """Feature table through Arrow batches; one matrix per batch, rows stay in their task."""
    return extract_windows(df, meta, grid, {"": (low, high)}, window).drop("roi")


def extract_windows(df: DataFrame, meta: list[str], grid: list[float],
                    windows: dict[str, tuple[float, float]], window=SMOOTH_WINDOW) -> DataFrame:
    """Feature rows for several potential windows (column ``roi``) from one pass over the curves."""
    spans = {name: roi_span(grid, low, high) for name, (low, high) in windows.items()}
    begin = min(first for first, _ in spans.values())
    stop = max(first + count for first, count in spans.values())
    for name, (_, count) in spans.items():
        if A.smooths(window) and window > count:
            raise ValueError(f"window '{name}' is shorter than the smoothing window {window}")
    pot = np.asarray(grid)
    source = df.select(*meta, F.slice("cur", begin + 1, stop - begin).alias("__window"))
    out = T.StructType([T.StructField("roi", T.StringType())] + [source.schema[name] for name in meta]
                       + [T.StructField(name, T.DoubleType()) for name in FEATURES])

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = list_matrix(batch.column(len(meta)), stop - begin)
            for name, (first, count) in spans.items():
                values = feature_matrix(pot[first:first + count],
                                        block[:, first - begin:first - begin + count], window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * batch.num_rows)]
                    + [batch.column(i) for i in range(len(meta))]
                    + [pa.array(np.ascontiguousarray(values[:, j])) for j in range(len(FEATURES))],
                    names=["roi"] + list(meta) + FEATURES)
    return source.mapInArrow(run, out)


def list_matrix(column, width: int) -> np.ndarray:
    """Arrow list column of fixed length as a matrix; missing values become NaN. Other lengths raise."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        wrong = int(lengths[lengths != width][0])
        raise ValueError(f"a curve has {'no values' if wrong < 0 else f'{wrong} points'}; {width} are needed")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), width)


def feature_matrix(pot: np.ndarray, raw: np.ndarray, window=SMOOTH_WINDOW) -> np.ndarray:
    """Features of a block of curves on one grid, one row per curve."""
    n, m = raw.shape
    ys = raw
    if A.smooths(window):
        half = window // 2
        wide = np.pad(raw, ((0, 0), (half, half)))
        ys = sum(wide[:, d:d + m] for d in range(window)) / window
    rows = np.arange(n)
    pos = np.arange(m)
    with np.errstate(all="ignore"):
        k = np.argmax(ys, axis=1)
        top = ys[rows, k]
        step = np.diff(pot)
        up = np.maximum(ys, 0.0)
        area = ((up[:, 1:] + up[:, :-1]) * step).sum(axis=1) / 2.0
        bg = ys[:, :max(5, int(0.10 * m))].mean(axis=1)
        to_bg = np.where(np.abs(bg) > EPS, top / bg, np.nan)

        before = pos[None, :] <= k[:, None]
        after = pos[None, :] >= k[:, None]
        rise = np.where(k >= 1, masked_slope(pot, ys, before), np.nan)
        fall = np.where(k < m - 1, masked_slope(pot, ys, after), np.nan)
        sym = np.where(np.abs(fall) > EPS, rise / fall, np.nan)

        d1 = block_gradient(step, ys)
        d2 = block_gradient(step, d1)
        mean = ys.mean(axis=1)
        dev = ys - mean[:, None]
        m2, m3, m4 = (dev ** 2).mean(axis=1), (dev ** 3).mean(axis=1), (dev ** 4).mean(axis=1)
        skew = np.where(m2 > 0, m3 / (m2 ** 1.5 + EPS), np.nan)
        kurt = np.where(m2 > 0, m4 / (m2 ** 2 + EPS), np.nan)
        values = {
            "Ip_corr": top, "Ep": pot[k], "Area_peak": area,
            "FWHM": block_fwhm(pot, ys, k, top), "Peak_to_bg": to_bg,
            "Slope_rise": rise, "Slope_fall": fall, "Symmetry": sym,
            "dIdE_max": row_max(d1), "d2IdE2_max": row_max(d2),
            "Mean": mean, "Var": m2, "Skew": skew, "Kurtosis": kurt,
            "Energy": (ys ** 2).sum(axis=1),
        }
    return np.column_stack([values[name] for name in FEATURES])


def masked_slope(pot, ys, mask):
    """Slope per row over the points of ``mask``; points outside must not leak NaN."""
    n = mask.sum(axis=1)
    mx = (mask * pot).sum(axis=1) / n
    dx = np.where(mask, pot[None, :] - mx[:, None], 0.0)
    return (dx * np.where(mask, ys, 0.0)).sum(axis=1) / (dx * dx).sum(axis=1)


def block_gradient(step, ys):
    left, right = np.diff(ys, axis=1)[:, :-1], np.diff(ys, axis=1)[:, 1:]
    hl, hr = step[:-1], step[1:]
    inner = (left * hr / hl + right * hl / hr) / (hl + hr)
    first = (ys[:, 1] - ys[:, 0]) / step[0]
    last = (ys[:, -1] - ys[:, -2]) / step[-1]
    return np.column_stack([first, inner, last])


def row_max(values):
    top = np.where(np.isnan(values), -np.inf, values).max(axis=1)
    return np.where(np.isnan(values).all(axis=1), np.nan, top)


def block_fwhm(pot, ys, k, top):
    n, m = ys.shape
    rows, pos = np.arange(n), np.arange(m)[None, :]
    half = top / 2.0
    below = ys < half[:, None]
    lo = np.where(below & (pos < k[:, None]), pos, -1).max(axis=1)
    hi = np.where(below & (pos > k[:, None]), pos, m).min(axis=1)
    ok = np.isfinite(top) & (top > 0) & (lo >= 0) & (hi < m)
    a, b = np.where(ok, lo, 0), np.where(ok, hi, 1)

    def cross(i0, i1, flat):
        y0, y1 = ys[rows, i0], ys[rows, i1]
        run = pot[i0] + (half - y0) * (pot[i1] - pot[i0]) / (y1 - y0)
        return np.where(y0 == y1, flat, run)
    left, right = cross(a, a + 1, pot[a]), cross(b - 1, b, pot[b])
    return np.where(ok, np.abs(right - left), np.nan)

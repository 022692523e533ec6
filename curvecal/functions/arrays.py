"""Column builders over one curve: ``pot`` and ``cur`` are arrays of equal length.

Every builder is a plain Column expression. ``let`` binds an intermediate array
once; without it the optimizer may inline an expensive array into the lambda that
reads it and evaluate it once per element.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvecal.constants import EPS, SMOOTH_WINDOW

NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def let_many(values: list[Column], body) -> Column:
    """Bind several independent values in one struct."""
    names = [f"v{i}" for i in range(len(values))]
    bound = F.struct(*[v.alias(n) for v, n in zip(values, names)])
    return let(bound, lambda s: body(*[s[n] for n in names]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(nan())


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def smooths(window) -> bool:
    return window is not None and window >= 3 and window % 2 == 1


def boxcar(cur: Column, window=SMOOTH_WINDOW) -> Column:
    """Centred moving sum over the full window width; the edges see zeros."""
    if not smooths(window):
        return cur
    half = window // 2

    def shifted(ys, k):
        def at(v, i):
            terms = [
                v if d == 0 else F.coalesce(F.get(ys, i + F.lit(d)), F.lit(0.0))
                for d in range(-half, half + 1)
            ]
            acc = terms[0]
            for term in terms[1:]:
                acc = acc + term
            return acc / F.lit(float(k))
        return F.transform(ys, at)

    return F.when(
        F.size(cur) < window,
        F.raise_error(F.lit(f"curve is shorter than the smoothing window {window}"))
        .cast("array<double>"),
    ).otherwise(let(cur, lambda ys: shifted(ys, window)))


def trapezoid(pot: Column, cur: Column) -> Column:
    """Trapezoid area; NaN below two points."""
    def area(es, ys):
        steps = F.transform(
            F.slice(es, 2, F.size(es) - 1),
            lambda e, i: (e - F.get(es, i)) * (F.get(ys, i + 1) + F.get(ys, i)) / 2.0,
        )
        return F.when(F.size(es) < 2, nan()).otherwise(total(steps))
    return let_many([pot, cur], area)


def clip_low(cur: Column, low: float = 0.0) -> Column:
    """Raise values below ``low``; NaN stays NaN (it is the greatest double in Spark)."""
    return F.transform(cur, lambda v: F.greatest(v, F.lit(low)))


def line_slope(pot: Column, cur: Column) -> Column:
    """Least-squares slope with intercept; NaN below two points."""
    def fit(es, ys):
        def centred(dx):
            num = total(F.zip_with(dx, ys, lambda a, b: a * b))
            den = total(F.transform(dx, lambda a: a * a))
            return F.coalesce(F.try_divide(num, den), nan())
        return F.when(F.size(es) < 2, nan()).otherwise(
            let(mean(es), lambda m: let(F.transform(es, lambda e: e - m), centred)))
    return let_many([pot, cur], fit)


def peak_index(cur: Column) -> Column:
    """Zero-based position of the first maximum; NaN counts as the maximum."""
    return (F.array_position(cur, F.array_max(cur)) - 1).cast("int")


def peak(pot: Column, cur: Column) -> Column:
    """Struct (Ip_corr, Ep)."""
    return let(cur, lambda ys: let(peak_index(ys), lambda k: F.struct(
        F.get(ys, k).alias("Ip_corr"), F.get(pot, k).alias("Ep"))))


def fwhm_at(es: Column, ys: Column, k: Column) -> Column:
    """Full width at half maximum around position ``k`` of already bound arrays."""
    n = F.size(ys)

    def crossing(i0, i1, flat):
        """Where the segment i0..i1 meets the half height."""
        x0, x1, y0, y1 = F.get(es, i0), F.get(es, i1), F.get(ys, i0), F.get(ys, i1)

        def place(half):
            slope = F.try_divide((half - y0) * (x1 - x0), y1 - y0)
            return F.when(y0 == y1, x0 if flat == 0 else x1).otherwise(x0 + slope)
        return place

    def width(top, half):
        below = F.transform(ys, lambda v: v < half)
        left = F.array_position(F.reverse(F.slice(below, 1, k)), F.lit(True))
        right = F.array_position(F.slice(below, k + 1, n - k), F.lit(True))

        def measure(lp, rp):
            i_left = (k - lp).cast("int")
            i_right = (k + rp - 1).cast("int")
            a = crossing(i_left, i_left + 1, 0)(half)
            b = crossing(i_right - 1, i_right, 1)(half)
            return F.when((lp > 0) & (rp > 0), F.abs(b - a)).otherwise(nan())
        return F.when(is_finite(top) & (top > 0), let_many([left, right], measure)).otherwise(nan())

    return F.when(n < 3, nan()).otherwise(
        let(F.get(ys, k), lambda top: width(top, top / 2.0)))


def fwhm(pot: Column, cur: Column) -> Column:
    return let_many([pot, cur], lambda es, ys: let(peak_index(ys), lambda k: fwhm_at(es, ys, k)))


def background_mean(cur: Column) -> Column:
    """Mean of the first tenth of the curve, five points at least."""
    n = F.size(cur)
    k = F.greatest(F.lit(5), F.floor(n * F.lit(0.10)).cast("int"))
    return mean(F.slice(cur, 1, k))


def peak_to_background(top: Column, background: Column) -> Column:
    return F.when(F.abs(background) > EPS, F.try_divide(top, background)).otherwise(nan())


def rise_slope(es: Column, ys: Column, k: Column) -> Column:
    return F.when(k >= 1, line_slope(F.slice(es, 1, k + 1), F.slice(ys, 1, k + 1))).otherwise(nan())


def fall_slope(es: Column, ys: Column, k: Column) -> Column:
    n = F.size(ys)
    return F.when(k < n - 1, line_slope(F.slice(es, k + 1, n - k), F.slice(ys, k + 1, n - k))
                  ).otherwise(nan())


def symmetry(rise: Column, fall: Column) -> Column:
    return F.when(~F.isnan(fall) & (F.abs(fall) > EPS), F.try_divide(rise, fall)).otherwise(nan())


def gradient(pot: Column, cur: Column) -> Column:
    """Second-order differences on an uneven grid, one-sided at both ends; null beside a repeated potential."""
    def slopes(es, ys):
        last = F.size(ys) - 1

        def at(v, i):
            left = v - F.get(ys, i - 1)
            right = F.get(ys, i + 1) - v

            def blend(hl, hr):
                inner = F.try_divide(F.try_divide(left * hr, hl) + F.try_divide(right * hl, hr), hl + hr)
                return F.when(i == 0, F.try_divide(right, hr)).when(i == last, F.try_divide(left, hl)).otherwise(inner)
            return let_many([F.get(es, i) - F.get(es, i - 1), F.get(es, i + 1) - F.get(es, i)], blend)
        return F.transform(ys, at)
    return let_many([pot, cur], slopes)


def finite_max(values: Column) -> Column:
    """Largest value that is neither null nor NaN; NaN when there is none."""
    return F.coalesce(F.array_max(F.filter(values, lambda v: ~F.isnan(v))), nan())


def moments(cur: Column) -> Column:
    """Struct (Mean, Var, Skew, Kurtosis): population moments, raw kurtosis."""
    def shape(m, m2, m3, m4):
        return F.struct(
            m.alias("Mean"),
            m2.alias("Var"),
            F.when(m2 > 0, m3 / (F.pow(m2, F.lit(1.5)) + EPS)).otherwise(nan()).alias("Skew"),
            F.when(m2 > 0, m4 / (m2 * m2 + EPS)).otherwise(nan()).alias("Kurtosis"),
        )

    def about(ys, m):
        def powers(dev):
            return let_many([
                mean(F.transform(dev, lambda d: d * d)),
                mean(F.transform(dev, lambda d: d * d * d)),
                mean(F.transform(dev, lambda d: d * d * d * d)),
            ], lambda m2, m3, m4: shape(m, m2, m3, m4))
        return let(F.transform(ys, lambda v: v - m), powers)
    return let(cur, lambda ys: let(mean(ys), lambda m: about(ys, m)))


def energy(cur: Column) -> Column:
    return total(F.transform(cur, lambda v: v * v))

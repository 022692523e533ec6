"""Principal components of curves: fit, scores, loadings, variance, link to the target."""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvecal.functions.solvers import Components, Moments
from curvecal.operators.gram import zero_filled


def score_columns(pc: Components, features: list[str] | str) -> list[F.Column]:
    """PC1, PC2, ... of one row as Column expressions."""
    count = len(pc.mean)
    if isinstance(features, str):
        raw = [zero_filled(F.get(features, F.lit(j))) for j in range(count)]
    else:
        raw = [zero_filled(F.col(c)) for c in features]
    out = []
    for k in range(pc.axes.shape[1]):
        axis = pc.axes[:, k]
        total = F.lit(float(-(axis @ pc.mean)))
        for w, term in zip(axis, raw):
            total = total + F.lit(float(w)) * term
        out.append(total.alias(f"PC{k + 1}"))
    return out


def pca_scores(df: DataFrame, pc: Components, features, keep: list[str]) -> DataFrame:
    return df.select(*keep, *score_columns(pc, features))


def pca_loadings(spark: SparkSession, pc: Components, labels: list) -> DataFrame:
    """(pc, position, label, loading)."""
    rows = [(k + 1, j, float(labels[j]) if not isinstance(labels[j], str) else None,
             str(labels[j]), float(pc.axes[j, k]))
            for k in range(pc.axes.shape[1]) for j in range(pc.axes.shape[0])]
    return spark.createDataFrame(rows, "pc int, position int, potential double, label string, loading double")


def pca_variance(spark: SparkSession, pc: Components) -> DataFrame:
    rows = [(k + 1, float(v), float(r)) for k, (v, r) in enumerate(zip(pc.variance, pc.ratio))]
    return spark.createDataFrame(rows, "pc int, variance double, ratio double")


def pca_scree(variance: DataFrame) -> DataFrame:
    """Individual and cumulative percent; one row per component, so the window is tiny."""
    upto = Window.partitionBy(F.lit(1)).orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    return variance.select(
        "pc", (F.col("ratio") * 100).alias("pct"), (F.sum("ratio").over(upto) * 100).alias("cum_pct"))


def component_correlation(spark: SparkSession, mom: Moments, pc: Components) -> DataFrame:
    """r, r squared and p of each component's scores with the target, from the moments alone."""
    _, sxy, syy = mom.centred()
    rows = []
    for k in range(pc.axes.shape[1]):
        own = pc.variance[k] * max(mom.n - 1, 1)
        scale = math.sqrt(own * syy)
        r = float(pc.axes[:, k] @ sxy / scale) if scale > 0 else None
        rows.append((k + 1, int(mom.n), r, None if r is None else r * r, correlation_p(r, int(mom.n))))
    return spark.createDataFrame(rows, "pc int, n bigint, r double, r2 double, p double")


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of r under no correlation (Student t, n - 2 degrees)."""
    if r is None or n < 3:
        return None
    dof = n - 2
    r2 = min(r * r, 1.0)
    return incomplete_beta(dof / 2.0, 0.5, 1.0 - r2)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)

"""Regression error tables over a prediction set (y_true, y_pred), grouped or not."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvecal.constants import BUCKETS, COVERAGE_PCT, OUTLIER_PPB, OUTLIER_TOL


def y_true() -> Column:
    return F.col("y_true")


def y_pred() -> Column:
    return F.col("y_pred")


def complete() -> Column:
    """Rows with a target and a prediction, neither null nor NaN."""
    return F.coalesce(~F.isnan(y_true()) & ~F.isnan(y_pred()) & y_true().isNotNull() & y_pred().isNotNull(), F.lit(False))


def error() -> Column:
    """Prediction minus target of a complete pair, else null."""
    return F.when(complete(), y_pred() - y_true())


def rmse() -> Column:
    return F.sqrt(F.avg(error() * error()))


def mae() -> Column:
    return F.avg(F.abs(error()))


def r2() -> Column:
    """All terms over the complete pairs."""
    known = F.when(complete(), y_true())
    return 1 - F.try_divide(F.sum(error() * error()), F.var_pop(known) * F.count(known))


def reg_metrics(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(complete()).alias("n"), rmse().alias("rmse"),
                               mae().alias("mae"), r2().alias("r2"))


def coverage(pct: float = COVERAGE_PCT, exclude_zeros: bool = True) -> tuple[Column, Column]:
    """(share within pct of the true value, rows used)."""
    used = y_true() > 0 if exclude_zeros else F.lit(True)
    close = F.when(F.abs(y_pred() - y_true()) <= F.lit(pct) * y_true(), 1.0).otherwise(0.0)
    return F.avg(F.when(used, close)), F.count_if(used)


def coverage_pct(df: DataFrame, by: list[str] = (), pct: float = COVERAGE_PCT,
                 exclude_zeros: bool = True) -> DataFrame:
    share, used = coverage(pct, exclude_zeros)
    return df.groupBy(*by).agg(share.alias("coverage"), used.alias("n_used"))


def in_bucket(y: Column, low: float, high: float | None) -> Column:
    inside = (y > low) & ~F.isnan(y)
    return inside if high is None else inside & (y <= high)


def bucket_stats(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Errors per concentration bucket; a bucket without rows keeps n = 0 and nulls.

    All buckets come from one aggregate, so an empty bucket needs no outer join.
    """
    aggs, cells = [], []
    err = y_pred() - y_true()
    for k, (label, low, high) in enumerate(BUCKETS):
        hit = in_bucket(y_true(), low, high)
        close = F.when(F.abs(err) <= F.lit(COVERAGE_PCT) * y_true(), 1.0).otherwise(0.0)
        aggs += [
            F.count_if(hit).alias(f"n{k}"),
            F.sqrt(F.avg(F.when(hit, err * err))).alias(f"rmse{k}"),
            F.avg(F.when(hit, F.abs(err))).alias(f"mae{k}"),
            F.avg(F.when(hit & (y_true() > 0), close)).alias(f"cov{k}"),
            F.count_if(hit & (y_true() > 0)).alias(f"used{k}"),
        ]
        cells.append(F.struct(
            F.lit(label).alias("bucket"), F.col(f"n{k}").alias("n"), F.col(f"rmse{k}").alias("rmse"),
            F.col(f"mae{k}").alias("mae"), F.col(f"cov{k}").alias("cov15"), F.col(f"used{k}").alias("n_cov")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def range_label(y: Column) -> Column:
    return (F.when(F.isnan(y), F.lit(None)).when(y <= 0, "zero").when(y <= 10, "low(0-10]")
            .when(y <= 25, "mid(10-25]").when(y > 25, "high(>25)"))


def range_errors(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Errors per coarse range; ranges without rows are left out."""
    return (df.withColumn("range", range_label(y_true())).where(F.col("range").isNotNull())
            .groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"), rmse().alias("rmse"), mae().alias("mae")))


def is_outlier(y: Column, label: float = OUTLIER_PPB, tol: float = OUTLIER_TOL) -> Column:
    return F.abs(y - F.lit(label)) <= F.lit(label * tol)


def without_outliers(df: DataFrame, y: str = "y_true", label: float = OUTLIER_PPB,
                     tol: float = OUTLIER_TOL) -> DataFrame:
    return df.where(~is_outlier(F.col(y), label, tol))


def outlier_counts(df: DataFrame, by: list[str] = (), y: str = "y_true", label: float = OUTLIER_PPB,
                   tol: float = OUTLIER_TOL) -> DataFrame:
    hit = is_outlier(F.col(y), label, tol)
    return df.groupBy(*by).agg(F.count_if(~hit).alias("kept"), F.count_if(hit).alias("removed"))


def per_sample(df: DataFrame, keep: list[str]) -> DataFrame:
    """Listing by true value (a range-partitioned sort)."""
    return df.select(*keep, "y_true", "y_pred").orderBy("y_true", *keep)


def per_sample_errors(df: DataFrame, keep: list[str]) -> DataFrame:
    err = y_pred() - y_true()
    return df.select(*keep, "y_true", "y_pred", err.alias("error"),
                     F.when(y_true() > 0, F.try_divide(err, y_true()) * 100).alias("rel_error_pct"))


def rmse_delta(metrics: DataFrame, baseline: float | None) -> DataFrame:
    """RMSE against a reference value; null without one."""
    ref = F.lit(baseline).cast("double")
    return metrics.withColumn("baseline_rmse", ref).withColumn("delta", F.col("rmse") - ref)

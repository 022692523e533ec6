"""Curve operators on long readings (sample_id, e, i, row_id) with uneven grids.

One sample may hold a large share of all readings, so neighbours are looked up inside
(sample, time slice) groups cut at overall quantiles; only the first and last reading
of each slice meet in a per-sample window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvecal.functions.arrays import nan
from curvecal.operators.ranking import probe, slice_of
from curvecal.session import join_groups


def with_neighbours(df: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    """Add ``prev`` and ``next`` structs (e, row_id, i); null at the ends of a sample."""
    cuts, _ = probe(df, F.col("e"), rows_per_slice)
    point = F.struct("e", "row_id", "i")
    if not cuts:
        inside = Window.partitionBy("sample_id").orderBy("e", "row_id")
        return df.withColumn("prev", F.lag(point).over(inside)).withColumn("next", F.lead(point).over(inside))
    rows = df.withColumn("slice", slice_of(F.col("e"), cuts))
    ends = rows.groupBy("sample_id", "slice").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    order = Window.partitionBy("sample_id").orderBy("slice")
    context = ends.select("sample_id", "slice", F.lag("last").over(order).alias("before"),
                          F.lead("first").over(order).alias("after"))
    inside = Window.partitionBy("sample_id", "slice").orderBy("e", "row_id")
    return (join_groups(rows, context, ["sample_id", "slice"])
            .withColumn("prev", F.coalesce(F.lag(point).over(inside), F.col("before")))
            .withColumn("next", F.coalesce(F.lead(point).over(inside), F.col("after")))
            .drop("slice", "before", "after"))


def trace_area(df: DataFrame) -> DataFrame:
    """Trapezoid area of the non-negative part per sample; NaN below two readings."""
    def low(v):
        return F.greatest(v, F.lit(0.0))
    strip = (F.col("e") - F.col("prev.e")) * (low(F.col("i")) + low(F.col("prev.i"))) / 2.0
    return (with_neighbours(df).groupBy("sample_id")
            .agg(F.coalesce(F.sum(strip), nan()).alias("area"), F.count(F.lit(1)).alias("n")))


def trace_slope(df: DataFrame) -> DataFrame:
    """Least-squares slope per sample; merges partial sums, needs no window."""
    return df.groupBy("sample_id").agg(
        F.coalesce(F.regr_slope("i", "e"), nan()).alias("slope"), F.count(F.lit(1)).alias("n"))


def local_slope() -> Column:
    """Second-order difference at a reading; one-sided where a neighbour is missing."""
    left, right = F.col("i") - F.col("prev.i"), F.col("next.i") - F.col("i")
    hl, hr = F.col("e") - F.col("prev.e"), F.col("next.e") - F.col("e")
    inner = F.try_divide(F.try_divide(left * hr, hl) + F.try_divide(right * hl, hr), hl + hr)
    return (F.when(F.col("prev").isNull(), F.try_divide(right, hr))
            .when(F.col("next").isNull(), F.try_divide(left, hl)).otherwise(inner))


def trace_d1_max(df: DataFrame) -> DataFrame:
    slope = local_slope()
    return (with_neighbours(df).withColumn("d", slope).groupBy("sample_id")
            .agg(F.coalesce(F.max(F.when(~F.isnan("d"), F.col("d"))), nan()).alias("d1_max")))

"""Baseline subtraction and exact column description."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal.constants import BASELINE_V
from curvecal.operators.ranking import exact_quantiles
from curvecal.session import join_groups


def baseline_index(grid: list[float], at: float = BASELINE_V) -> int:
    """First grid point nearest to ``at``."""
    return min(range(len(grid)), key=lambda k: (abs(grid[k] - at), k))


def baseline_subtract(df: DataFrame, grid: list[float] | None = None, at: float = BASELINE_V) -> DataFrame:
    """Shift each curve so that its value nearest ``at`` becomes 0.

    With ``grid`` the position is known before the job; otherwise it is found per row.
    """
    if grid is not None:
        level = F.get("cur", F.lit(baseline_index(grid, at)))
        return df.withColumn("cur", F.transform("cur", lambda v: v - level))
    gap = F.transform("pot", lambda e: F.abs(e - F.lit(at)))
    place = F.transform(F.array(gap), lambda g: F.array_position(g, F.array_min(g)))[0]
    moved = F.transform(
        F.array(F.get("cur", (place - 1).cast("int"))),
        lambda level: F.transform(F.col("cur"), lambda v: v - level))[0]
    return df.withColumn("cur", moved)


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per group."""
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quart = exact_quantiles(df, value, [0.25, 0.5, 0.75], by)
    return join_groups(basic, quart.select(
        *by, F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75")), by, "left")

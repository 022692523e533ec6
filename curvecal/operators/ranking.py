"""Exact order statistics and running counts without one-task windows.

A window over a whole group puts the group in one task. Here values are cut into slices first,
each (group, slice) gets its own running sum, and slice totals are added as offsets. The
cuts only balance the work: results are exact for any cuts, and a value that repeats is
counted before anything is shuffled.
"""

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from curvecal.functions.arrays import let
from curvecal.session import join_groups, materialize

GROUP = 64
MAX_SLICES = GROUP * GROUP
ROWS_PER_SLICE = 250_000


def probe(df: DataFrame, value: Column, rows_per_slice: int | None = None,
          **extra: Column) -> tuple[list[float], Row]:
    """(cut values, row of ``extra`` aggregates) from one aggregate over the data.

    Small inputs get no cuts. Beyond ``GROUP`` slices a second aggregate refines them;
    at most ``MAX_SLICES`` numbers ever reach the driver.
    """
    def quantiles(count):
        probs = [i / count for i in range(1, count)]
        return F.percentile_approx(value, probs, 10_000).alias("cuts")
    row = df.agg(F.count(value).alias("rows"), quantiles(GROUP),
                 *[c.alias(k) for k, c in extra.items()]).first()
    slices = min(MAX_SLICES, math.ceil(row["rows"] / (rows_per_slice or ROWS_PER_SLICE)))
    if slices <= 1:
        return [], row
    cuts = row["cuts"] if slices <= GROUP else df.agg(quantiles(slices)).first()["cuts"]
    return sorted({float(v) for v in cuts}), row


def slice_of(value: Column, cuts: list[float]) -> Column:
    """Slice number, ascending in ``value``; a two-step lookup of literal cuts.

    Never null, so that no null check of it is pushed below an aggregate.
    """
    if not cuts:
        return F.lit(0)

    groups = [cuts[i:i + GROUP] for i in range(0, len(cuts), GROUP)]
    if len(groups) == 1:
        return lookup(value, groups[0])
    fine = F.array(*[F.lit(g) for g in groups])
    place = let(lookup(value, [g[-1] for g in groups[:-1]]), lambda k: k * F.lit(GROUP + 1) + F.size(
        F.filter(F.get(fine, k), lambda e: e < value)))
    return F.coalesce(place, F.lit(0))


def lookup(value: Column, edges: list[float], base: int = 0) -> Column:
    """Number of ``edges`` below ``value``, as a balanced tree of comparisons."""
    if not edges:
        return F.lit(base)
    mid = len(edges) // 2
    return F.when(value > edges[mid], lookup(value, edges[mid + 1:], base + mid + 1)).otherwise(
        lookup(value, edges[:mid], base))


def comparable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def running_counts(df: DataFrame, value: str, by: list[str] = (), sums: dict[str, Column] | None = None,
                   parts: int | None = None) -> DataFrame:
    """One row per (by, value), NaN and null left out, ascending running totals.

    Columns: ``n`` rows with the value, ``cum_n`` rows up to it, ``all_n`` rows of the
    group, and the same three for every entry of ``sums``.

    Values are counted first, so a hot value is one row. The counts are dealt to Spark's own ranges of
    (by, value) and written with the number of their range; totals of the ranges, one row per range and
    group in it, become offsets. ``parts`` sets the number of ranges (else the session's partitions).
    """
    by = list(by)
    sums = {"n": F.count(F.lit(1)), **{k: F.sum(v) for k, v in (sums or {}).items()}}
    rows = df.where(comparable(F.col(value)))
    counts = rows.groupBy(*by, value).agg(*[agg.alias(name) for name, agg in sums.items()])
    dealt = counts.repartitionByRange(parts, *by, value) if parts else counts.repartitionByRange(*by, value)
    # written before the number of a range is used: dealing them out again could cut elsewhere
    counts = materialize(dealt.withColumn("slice", F.spark_partition_id()), "ranges")
    totals = counts.groupBy(*by, "slice").agg(*[F.sum(k).alias(f"part_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by, "slice", *[F.coalesce(F.sum(f"part_{k}").over(before), F.lit(0)).alias(f"off_{k}") for k in sums],
        *[F.sum(f"part_{k}").over(whole).alias(f"all_{k}") for k in sums])
    upto = Window.partitionBy(*by, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select(*by, value, "slice", *sums, *[F.sum(k).over(upto).alias(f"cum_{k}") for k in sums])
    return join_groups(running, offsets, [*by, "slice"]).select(
        *by, value, *sums, *[(F.col(f"off_{k}") + F.col(f"cum_{k}")).alias(f"cum_{k}") for k in sums],
        *[f"all_{k}" for k in sums])


def lerp(lo, hi, t):
    return hi - (hi - lo) * (1 - t) if t >= 0.5 else lo + (hi - lo) * t


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str],
                    parts: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...``, one row per group."""
    runs = running_counts(df, value, by, parts=parts)
    v, first, last = F.col(value).cast("double"), F.col("cum_n") - F.col("n"), F.col("cum_n")
    at = [F.lit(float(p)) * (F.col("all_n") - 1) for p in probs]
    picks = []
    for k, r in enumerate(at):
        for name, rank in (("lo", F.floor(r)), ("hi", F.ceil(r))):
            picks.append(F.max(F.when((first <= rank) & (rank < last), v)).alias(f"{name}{k}"))
    found = runs.groupBy(*by).agg(F.max("all_n").alias("all_n"), *picks)

    def blend(k):
        t, lo, hi = at[k] - F.floor(at[k]), F.col(f"lo{k}"), F.col(f"hi{k}")
        return F.when(t >= 0.5, hi - (hi - lo) * (1 - t)).otherwise(lo + (hi - lo) * t)
    return found.select(*by, *[blend(k).alias(f"q{k}") for k in range(len(probs))])

"""Potential grids: consistency, filling, naming, sharing."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvecal.constants import GRID_ATOL, NAME_DECIMALS, TARGET
from curvecal.functions.arrays import nan


def grid_name(e: float, prefix: str = "E", decimals: int = NAME_DECIMALS) -> str:
    return f"{prefix}_{e:.{decimals}f}"


def grid_name_column(e: Column, prefix: str = "E", decimals: int = NAME_DECIMALS) -> Column:
    return F.format_string(f"{prefix}_%.{decimals}f", e)


def same_grid(pot: Column, reference: Column, atol: float = GRID_ATOL) -> Column:
    """Equal length and every potential within ``atol``."""
    near = F.forall(F.zip_with(pot, reference, lambda a, b: F.abs(a - b) <= atol), lambda ok: ok)
    return (F.size(pot) == F.size(reference)) & F.coalesce(near, F.lit(False))


def reference_grid(df: DataFrame) -> list[float]:
    """Grid of the first file in name order (one row from a partial aggregate)."""
    return list(df.agg(F.min_by("pot", F.struct("source_file", "sample_id")).alias("pot")).first()["pot"])


def grid_check(df: DataFrame, strict: bool = False, atol: float = GRID_ATOL) -> DataFrame:
    """Per file: curves, curves off the reference grid. ``strict`` raises on the first one."""
    bad = ~same_grid(F.col("pot"), F.lit(reference_grid(df)), atol)
    report = df.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("curves"), F.count_if(bad).alias("mismatched"))
    if strict:
        worst = report.where(F.col("mismatched") > 0).orderBy("source_file").first()
        if worst:
            raise ValueError(f"potential grid mismatch in '{worst['source_file']}'")
    return report


def grid_fill(df: DataFrame, grid: list[float], decimals: int = NAME_DECIMALS) -> DataFrame:
    """Put curves on ``grid`` by rounded potential: missing points NaN, extra points dropped.

    The lookup stays inside the row; of two points with one name the later counts.
    """
    n = F.size("cur")
    names = F.transform(F.reverse("pot"), lambda e: F.round(e, decimals))

    def pick(keys, values):
        return F.transform(F.lit([round(e, decimals) for e in grid]), lambda g: F.coalesce(
            F.get(values, (F.array_position(keys, g) - 1).cast("int")), nan()))
    bound = F.struct(names.alias("k"), F.reverse("cur").alias("v"))
    filled = F.transform(F.array(bound), lambda s: pick(s["k"], s["v"]))[0]
    return df.withColumn("cur", filled).withColumn("pot", F.lit(grid)).withColumn("points_in", n)


def normalized_names(columns: list[str], target: str = TARGET,
                     decimals: int = NAME_DECIMALS) -> dict[str, str]:
    """Column -> ``V_<number>`` from the first number in each header."""
    out: dict[str, str] = {}
    for c in columns:
        if c == target:
            continue
        found = re.search(r"-?\d+(?:\.\d+)?", c)
        if not found:
            raise ValueError(f"no potential in column name '{c}'")
        name = grid_name(round(float(found.group()), decimals), "V", decimals)
        if name in out.values():
            raise ValueError(f"two columns fall on '{name}'")
        out[c] = name
    return out


def normalize_columns(df: DataFrame, target: str = TARGET, decimals: int = NAME_DECIMALS,
                      as_text: bool = True) -> DataFrame:
    """Target plus ``V_*`` columns; ``as_text`` orders names as strings, else by value."""
    names = normalized_names(df.columns, target, decimals)
    ordered = sorted(names, key=lambda c: names[c] if as_text else float(names[c][2:]))
    return df.select(target, *[F.col(f"`{c}`").alias(names[c]) for c in ordered])


def align_columns(left: DataFrame, right: DataFrame, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to their shared potential columns, in one order."""
    shared = sorted((set(left.columns) & set(right.columns)) - {target})
    if not shared:
        raise ValueError("no shared potential columns")
    picked = [target] + [f"`{c}`" for c in shared]
    return left.select(*picked), right.select(*picked)


def shared_positions(left: list[float], right: list[float],
                     decimals: int = NAME_DECIMALS) -> tuple[list[float], list[int], list[int]]:
    """Shared rounded potentials (ascending) and where they sit in each grid."""
    a = {round(e, decimals): k for k, e in enumerate(left)}
    b = {round(e, decimals): k for k, e in enumerate(right)}
    both = sorted(set(a) & set(b))
    if not both:
        raise ValueError("no shared potentials")
    return both, [a[e] for e in both], [b[e] for e in both]

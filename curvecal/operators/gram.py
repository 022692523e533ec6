"""Fold-wise moments: one scan of the rows serves every fold and every linear model."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvecal.functions.features import list_matrix
from curvecal.functions.solvers import Moments

FAN_IN = 64  # moments that one merge takes, once a level holds no more than the session's partitions


def zero_filled(value: Column) -> Column:
    """Missing or NaN becomes 0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=cols)


def design(df: DataFrame, features: list[str] | str, y: str, keep: list[str] = ()) -> DataFrame:
    """Rows with one array ``x`` of imputed features and target ``y``."""
    if isinstance(features, str):
        x = F.transform(F.col(features), zero_filled)
    else:
        x = F.array(*[zero_filled(F.col(c)) for c in features])
    return df.select(*keep, F.col(y).cast("double").alias("y"), x.alias("x"))


def matrix_schema(group: str) -> str:
    return f"{group} string, slot int, m array<double>"


def pack_moments(parts: dict[str, Moments], group: str, slot: int | None = None) -> pa.RecordBatch:
    """One row per key with its packed moments, marked with the task that made them (or a merge slot)."""
    slot = TaskContext.get().partitionId() if slot is None else slot
    return pa.RecordBatch.from_arrays(
        [pa.array(list(parts), pa.string()), pa.array([slot] * len(parts), pa.int32()),
         pa.array([m.pack() for m in parts.values()], pa.list_(pa.float64()))],
        names=[group, "slot", "m"])


def targets(column) -> np.ndarray:
    """Arrow column of targets; a missing one would spoil every fit, so it raises."""
    y = column.to_numpy(zero_copy_only=False).astype(float, copy=False)
    if np.isnan(y).any():
        raise ValueError(f"{int(np.isnan(y).sum())} rows of a batch have no target; leave them out before fitting")
    return y


def gram_partials(rows: DataFrame, width: int, group: str = "g") -> DataFrame:
    """One row per group: (group, slot, packed moments of x and y).

    Each task folds its rows into one set of moments per group before emitting.
    """
    def accumulate(batches):
        parts: dict[str, Moments] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = np.column_stack([list_matrix(batch.column(2), width), targets(batch.column(1))])
            for key, index in groups_of(batch.column(0)):
                own = Moments.of(z[index])
                parts[key] = parts[key] + own if key in parts else own
        if parts:
            yield pack_moments(parts, group)

    source = rows.select(F.col(group).cast("string").alias(group), "y", "x")
    return merge_moments(source.mapInArrow(accumulate, matrix_schema(group)), width + 1, group)


def merge_levels(width: int, fan_in: int = FAN_IN) -> list[int]:
    """Merge slots of each level: ``width`` first, then each takes at most ``fan_in`` of the one before, down to 1."""
    levels = [max(1, width)]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // fan_in))
    return levels


def merge_moments(parts: DataFrame, size: int, group: str, fan_in: int | None = None) -> DataFrame:
    """Combine per-task moments to one row per group, level by level.

    The first level spreads the tasks over as many merges as the session has shuffle partitions, so it is
    as wide as the cluster however many tasks read the data; each further level takes ``fan_in`` of
    those at a time.
    """
    levels = merge_levels(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_in or FAN_IN)

    def merge(slots):
        def run(batches):
            held: dict[tuple[str, int], Moments] = {}
            for batch in batches:
                for key, slot, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    own, place = Moments.unpack(np.array(m.values), size), (key, slot % slots)
                    held[place] = held[place] + own if place in held else own
            for (key, slot), m in held.items():
                yield pack_moments({key: m}, group, slot)
        return run

    schema = matrix_schema(group)
    for slots in levels:
        dealt = parts.repartition(group) if slots == 1 else parts.repartition(F.col("slot") % slots, group)
        parts = dealt.mapInArrow(merge(slots), schema)
    return parts


def groups_of(column):
    """(key, row positions) of an Arrow string column."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for code, key in enumerate(coded.dictionary.to_pylist()):
        yield key, np.flatnonzero(codes == code)


def gram_by_group(rows: DataFrame, width: int, group: str = "g") -> dict[str, Moments]:
    """Moments per group on the driver: about (width + 1)^2 numbers each, whatever the rows."""
    return {r[group]: Moments.unpack(np.array(r["m"]), width + 1)
            for r in gram_partials(rows, width, group).collect()}


def gram_table(rows: DataFrame, width: int, group: str = "g", per_row: bool = False) -> DataFrame:
    """Raw cross products as rows (group, i, j, v); index 0 is the constant, the last is y.

    ``per_row`` divides them by the number of rows.
    """
    size = width + 1
    n = F.get("m", F.lit(0))

    def mean(k):
        return F.when(k == 0, F.lit(1.0)).otherwise(F.get("m", k))
    axes = F.sequence(F.lit(0), F.lit(size))
    cells = (gram_partials(rows, width, group).select(group, "m", F.explode(axes).alias("i"))
             .select(group, "m", "i", F.explode(axes).alias("j")))
    i, j = F.col("i"), F.col("j")
    spread = F.when((i > 0) & (j > 0), F.get("m", F.lit(size + 1) + (i - 1) * size + j - 1)).otherwise(F.lit(0.0))
    means = mean(i) * mean(j)
    value = spread / n + means if per_row else spread + n * means
    return cells.select(group, "i", "j", value.alias("v"))


def add(moments) -> Moments:
    items = list(moments)
    out = items[0]
    for m in items[1:]:
        out = out + m
    return out


def scaler(df: DataFrame, cols: list[str], with_std: bool = True) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column; a constant column keeps scale 1."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        sd = row[f"s{i}"] if with_std else 1.0
        out[c] = (row[f"m{i}"], sd if sd else 1.0)
    return out


def apply_scaler(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / F.lit(s) for c, (m, s) in fitted.items()})

"""Selection, union, alignment and picking over feature and curve tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.constants import (
    FEATURES, FLAGGED, META, NOT_FEATURES, PICK_LIMIT, PICK_TARGETS, PICK_TOL, TARGET,
)


def dataset_union(lab: DataFrame, unseen: DataFrame) -> DataFrame:
    """UNION ALL by name with a ``dataset`` label."""
    return (lab.withColumn("dataset", F.lit("lab"))
            .unionByName(unseen.withColumn("dataset", F.lit("unseen"))))


def feature_select(df: DataFrame, exclude: list[str] = NOT_FEATURES) -> list[str]:
    """Numeric columns that are not meta, target or label, in table order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def feature_align(left: DataFrame, right: DataFrame) -> list[str]:
    """Shared numeric features, alphabetical."""
    shared = sorted(set(feature_select(left)) & set(feature_select(right)))
    if not shared:
        raise ValueError("no shared numeric feature columns")
    return shared


def align_by_key(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of both tables for one sample; equal row order is never assumed."""
    return left.join(right, key)


def feature_project(df: DataFrame) -> DataFrame:
    """Meta columns that exist, then features, then flags."""
    wanted = META + FEATURES + [f"{c}_valid" for c in FLAGGED]
    return df.select(*[c for c in wanted if c in df.columns])


def sample_pick(df: DataFrame, order: str, keep: list[str], y: str = TARGET,
                targets: list[float] = PICK_TARGETS, tol: float = PICK_TOL,
                limit: int = PICK_LIMIT) -> DataFrame:
    """For each target the first row in ``order`` that lies within ``tol`` (0: exactly).

    One aggregate with a conditional first row per target; no join, no window.
    """
    row = F.struct(F.col(order).alias("picked_order"), *keep)
    picks = []
    for k, t in enumerate(targets):
        hit = (F.col(y) == 0.0) if t == 0 else F.col(y).between(t - tol, t + tol)
        picks.append(F.min(F.when(hit, row)).alias(f"p{k}"))
    cells = F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(float(t)).alias("target"),
                               F.col(f"p{k}").alias("row")) for k, t in enumerate(targets)])
    found = F.slice(F.filter(cells, lambda c: c["row"].isNotNull()), 1, limit)
    return (df.agg(*picks).select(F.inline(found))
            .select("slot", "target", "row.picked_order", *[f"row.{c}" for c in keep]))

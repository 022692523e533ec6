"""Wide tables, CSV exchange, counts and schema checks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.constants import TARGET
from curvecal.operators.grids import grid_name


def curve_to_wide(df: DataFrame, grid: list[float], meta: list[str], prefix: str = "E") -> DataFrame:
    """Meta, then one column per potential ascending; a projection, no pivot shuffle."""
    order = sorted(range(len(grid)), key=lambda k: grid[k])
    return df.select(*meta, *[F.get("cur", F.lit(k)).alias(grid_name(grid[k], prefix)) for k in order])


def wide_grid(columns: list[str], prefix: str = "E_") -> list[tuple[float, str]]:
    """(potential, column) ascending; an error when no column has the prefix."""
    found = sorted((float(c[len(prefix):]), c) for c in columns if c.startswith(prefix))
    if not found:
        raise ValueError(f"no potential columns (expected names like '{prefix}-0.4507')")
    return found


def wide_to_curve(df: DataFrame, prefix: str = "E_") -> tuple[DataFrame, list[float]]:
    """Curve rows and their grid from a wide table; a projection."""
    pairs = wide_grid(df.columns, prefix)
    names = {c for _, c in pairs}
    meta = [F.col(f"`{c}`") for c in df.columns if c not in names]
    cells = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for _, c in pairs]
    return df.select(*meta, F.array(*cells).alias("cur")), [e for e, _ in pairs]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema; columns are checked against the header."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index; NaN is an empty cell, a quote inside a text is doubled."""
    cells = [F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name)
             if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
             for f in df.schema]
    df.select(*cells).write.csv(path, header=True, escape='"')


def class_counts(df: DataFrame, y: str = TARGET) -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy(y)


def dataset_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).orderBy("dataset")


def require(df: DataFrame, columns: list[str] = (), prefix: str | None = None) -> DataFrame:
    """Schema check before any job: named columns exist, and some column has ``prefix``."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if prefix and not any(c.startswith(prefix) for c in df.columns):
        raise ValueError(f"no columns starting with '{prefix}'")
    return df


def width_report(df: DataFrame, grid: list[float]) -> DataFrame:
    """Rows, rows whose curve length differs from the grid, rows without a target."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("cur") != len(grid)).alias("bad_width"),
        F.count_if(F.col(TARGET).isNull()).alias("no_target"))


def preview(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    """First rows in file order (a top-k, not a full sort)."""
    return df.orderBy(order).limit(rows)

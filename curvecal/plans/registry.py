"""Registered queries: a callable (spark, folder) -> DataFrame and, where SQL can say it, its SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.session import ship_package

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its doubles are rounded to six digits and NaN becomes null."""
    def add(fn):
        def run(spark, folder):
            ship_package(spark)
            return rounded(fn(spark, folder))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def r6(expr: str) -> str:
    """SQL counterpart of ``rounded`` for one expression."""
    return f"(round({expr}, 6) + CAST(0 AS DOUBLE))"

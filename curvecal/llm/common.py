"""Small helpers shared by the corpus operators."""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@contextmanager
def shuffle_files_freed(spark: SparkSession):
    """Jobs run inside drop their shuffle files when they end, not at the driver's next collection."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in a table: one narrow scan and one number on the driver."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def unused_names(taken: list[str], count: int) -> list[str]:
    """Column names that differ from ``taken`` in more than case."""
    taken = {c.lower() for c in taken}
    names = (f"_{i}" for i in range(len(taken) + count))
    return [n for n in names if n not in taken][:count]

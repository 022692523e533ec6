"""Views of the shared test tables as curves, traces, scores and tabular rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = [round(-0.4507 + 0.0102042 * k, 4) for k in range(64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """One curve per embedding row: ``cur`` over the fixed ``GRID``."""
    vec = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        vec.cast("string").alias("sample_id"),
        (F.col("label") * F.lit(3.38)).alias("concentration_ppb"),
        F.format_string("Ac TW %dppb.csv", F.col("label")).alias("source_file"),
        F.when(vec % 5 < 3, "lab").otherwise("unseen").alias("dataset"),
        F.col("embedding").cast("array<double>").alias("cur"),
        vec.alias("row_id"),
    )


def with_pot(df: DataFrame, grid=None) -> DataFrame:
    """Put the shared grid on every row, for operators that read a grid per row."""
    return df.withColumn("pot", F.lit(grid or GRID))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Long readings of one user per event, on uneven time."""
    since = F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def part(unit):
        return F.extract(F.lit(unit), since)
    whole = part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60
    micros = whole.cast("bigint") * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("sample_id"),
        (micros.cast("double") / 1e6).alias("e"),
        F.col("value").alias("i"),
        F.col("event_id").alias("row_id"),
    )


def line_key() -> "F.Column":
    """Unique integer-only key of a line item row."""
    return F.concat_ws(
        "-",
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        (F.col("l_extendedprice") * 100 + 0.5).cast("bigint"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction set: (sample_id, model, y_true, y_pred)."""
    true = (F.col("l_quantity") - 1) * F.lit(0.65)
    return table(spark, folder, "lineitem").select(
        line_key().alias("sample_id"),
        F.col("l_returnflag").alias("model"),
        true.alias("y_true"),
        (true + F.lit(40.0) * (F.col("l_tax") - F.col("l_discount"))).alias("y_pred"),
    )


TABULAR = ["qty", "disc", "tax", "size", "retail"]


def tabular(spark: SparkSession, folder: str) -> DataFrame:
    """Flat regression rows: target ``y`` and five numeric features."""
    items = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        line_key().alias("sample_id"),
        F.when(F.col("l_linestatus") == "O", "unseen").otherwise("lab").alias("dataset"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_discount").cast("double").alias("disc"),
        F.col("l_tax").cast("double").alias("tax"),
        F.col("p_size").cast("double").alias("size"),
        (F.col("p_retailprice") / 1000).alias("retail"),
        (F.col("l_linenumber") % 5).alias("grp"),
    )

"""Scan files: discovery, headerless matrices, replicates to curves."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvecal.functions.arrays import nan

# The concentration patterns of scan file names.
WHOLE_PPB = r"(?i)(\d+)\s*ppb"
DECIMAL_PPB = r"(?i)(\d+(?:\.\d+)?)\s*ppb"


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(source_file, path, length) in name order; contents are not read. Raises when empty."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(folder)
             .select(file_name(F.col("path")).alias("source_file"), "path", "length"))
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    return files.orderBy("source_file")


def file_name(path: Column) -> Column:
    """Name of a scan: the file, or the ``scan=`` folder a distributed writer made for it."""
    folder = F.regexp_extract(path, r"/scan=([^/]+)/[^/]*$", 1)
    return F.url_decode(F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1)))


def scan_path(path: Column) -> Column:
    """What identifies a scan: the path of its file, or of the ``scan=`` folder made for it."""
    folder = F.regexp_extract(path, r"^(.*/scan=[^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(path)


def concentration_from_name(name: Column, decimals: bool = False) -> Column:
    """Number before 'ppb', any case; an error when there is none.

    The default reads whole digits only, so '16.9ppb' gives 9; ``decimals`` reads 16.9.
    """
    found = F.regexp_extract(name, DECIMAL_PPB if decimals else WHOLE_PPB, 1)
    kind = "double" if decimals else "int"
    return F.when(found == "", F.raise_error(
        F.concat(F.lit("no concentration in file name: "), name)).cast(kind)).otherwise(
        F.when(found != "", found).cast(kind))


def read_traces(spark: SparkSession, folder: str, pattern: str = "*", sep: str = ",") -> DataFrame:
    """Long points (scan, source_file, replicate, e, i) of headerless matrices of any width.

    ``scan`` is the whole path and tells scans of one name in different folders apart.

    Column 0 is the potential, column i the current of replicate i; an empty cell is NaN.
    """
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .text(folder).where(F.trim("value") != "")
             .select(scan_path(F.col("_metadata.file_path")).alias("scan"),
                     file_name(F.col("_metadata.file_path")).alias("source_file"),
                     F.split("value", F.lit(sep)).alias("cells")))
    number = F.col("cell").try_cast("double")
    points = lines.select(
        "scan", "source_file", F.get("cells", F.lit(0)).cast("double").alias("e"),
        F.posexplode(F.slice("cells", 2, F.size("cells") - 1)).alias("pos", "cell"))
    return points.select("scan", "source_file", (F.col("pos") + 1).alias("replicate"), "e",
                         F.coalesce(number, nan()).alias("i"))


def replicates_to_curves(points: DataFrame, decimals: bool = False) -> DataFrame:
    """One row per (scan, replicate), ascending in potential.

    A group is one scan, so its size is the instrument grid, not the number of scans.
    """
    pairs = F.array_sort(F.collect_list(F.struct("e", "i")))
    curves = points.groupBy("scan", "source_file", "replicate").agg(pairs.alias("pts"))
    ppb = concentration_from_name(F.col("source_file"), decimals)
    label = F.format_string("%sppb_S%d", ppb.cast("string"), F.col("replicate"))
    return curves.select(
        label.alias("sample_id"), ppb.cast("double").alias("concentration_ppb"), "scan", "source_file",
        "replicate", F.col("pts.e").alias("pot"), F.col("pts.i").alias("cur"))


def write_traces(curves: DataFrame, grid: list[float], scan: str, number: str, path: str,
                 per_file: int = 50) -> None:
    """Headerless matrices, one ``scan=<name>`` folder per file, columns ordered by ``number``.

    A line holds one potential of all replicates of a file, so a scan with more than
    ``per_file`` consecutive numbers is written as several files ('part<k> <scan>').
    """
    block = F.floor(F.col(number) / per_file).cast("bigint")
    points = curves.select(
        F.format_string("part%d %s", block, F.col(scan)).alias("scan"), F.col(number).alias("number"),
        F.posexplode(F.arrays_zip(F.lit(grid).alias("e"), F.col("cur").alias("i"))).alias("k", "p"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("number", F.col("p.i").alias("i")))),
                        lambda c: c["i"].cast("string"))
    lines = points.groupBy("scan", "k").agg(F.max("p.e").alias("e"), cells.alias("cells"))
    text = F.concat_ws(",", F.array_prepend(F.col("cells"), F.col("e").cast("string")))
    (lines.select("scan", "k", text.alias("value"))
     .repartition("scan").sortWithinPartitions("scan", "k").select("scan", "value")
     .write.partitionBy("scan").text(path))

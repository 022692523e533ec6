"""Session defaults and hand-over tables."""

import os
import pkgutil
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

BROADCAST_ROWS = 10_000


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("curvecal")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a session without the setting (a local test) falls back to a new
    temporary folder, and the choice is written back so that one session keeps one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("curvecal.scratch", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="curvecal-")
        spark.conf.set("curvecal.scratch", named)
    return named


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage; the cluster's own setting is kept."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, row_group_mb: int = 32) -> DataFrame:
    """Write a table several later passes read, and return a scan of it.

    The files outlive lost executors, later passes prune columns on them, and the
    expensive upstream plan runs once. Moderate row groups let a later scan split a file
    that one upstream task wrote.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("parquet.block.size", row_group_mb << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the key columns appear once."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in on})
    match = None
    for c in on:
        same = left[c].eqNullSafe(renamed[f"__{c}"])
        match = same if match is None else match & same
    return left.join(renamed, match, how).drop(*[f"__{c}" for c in on])


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(left: DataFrame, summary: DataFrame, on: list[str], how: str = "inner",
           limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a per-group summary back to its rows.

    At most ``limit`` + 1 rows of the summary are fetched. If that is all of it, those
    rows are broadcast, so the large side is not shuffled and the summary is not
    computed twice. Otherwise the join is left to the optimizer. A summary row is a key and
    a few numbers, so the limit also bounds its bytes. Rows with a null key keep their group.
    """
    rows = summary.limit(limit + 1).collect()
    if len(rows) <= limit:
        summary = F.broadcast(left.sparkSession.createDataFrame(rows, summary.schema))
    return join_groups(left, summary, on, how)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session that lacks it."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="curvecal-"), "curvecal")
    context.addPyFile(shutil.make_archive(base, "zip", root, "curvecal"))
    _shipped.append(context)


_shipped: list = []


def java_function(spark: SparkSession, package: str, name: str, returns: str) -> str:
    """Name for SQL of the Java UDF ``curvecal.<name>``, whose source lies beside the modules of ``package``.

    The compiler that Spark's generated code goes through translates it on the driver; executors get a jar.
    """
    context, jvm = spark.sparkContext, spark._jvm
    if (context, name) not in _compiled:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data(package, f"{name}.java").decode())
        jar = os.path.join(tempfile.mkdtemp(prefix="curvecal-"), f"{name}-{uuid.uuid4().hex}.jar")
        classes = compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as out:
            for found in classes.keySet():
                out.writestr(found.replace(".", "/") + ".class", bytes(classes.get(found)))
        context._jsc.addJar(jar)
        none = context._gateway.new_array(jvm.java.lang.Class, 0), context._gateway.new_array(jvm.java.lang.Object, 0)
        made = compiler.getClassLoader().loadClass(f"curvecal.{name}").getDeclaredConstructor(none[0]).newInstance(none[1])
        _compiled[context, name] = made
    kind = spark._jsparkSession.parseDataType(DataType.fromDDL(returns).json())
    spark._jsparkSession.udf().register(f"curvecal_{name}", _compiled[context, name], kind)
    return f"curvecal_{name}"


_compiled: dict = {}

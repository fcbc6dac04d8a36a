"""Session settings and the shared folder for intermediate tables."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Splits the shuffle partitions of a hot creator, project or link key at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Larger generated methods are never compiled to machine code; the rule chains of the
    # validation jobs run faster as several smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # A record that names a field twice keeps the last value instead of being refused.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Bytes up to which a side is broadcast. Spark estimates them from sizes of compressed files,
#: and the rows of a file can take 20 to 30 times as much memory.
BROADCAST = 1 << 20


def _bound_broadcasts(spark: SparkSession) -> None:
    """Lower the limit of broadcasts to ``BROADCAST``; a lower one, or none at all, stays."""
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the queries rely on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _bound_broadcasts(spark)
    return spark


def local_session(cores="*", shuffle_partitions=8, memory="8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("engagement")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a ``local`` session may fall back to a folder of its own: elsewhere a lost
    executor would take a machine-local folder with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="engagement-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/engagement/{uuid.uuid4().hex}/{name}"


def make_folder(spark: SparkSession, path: str) -> None:
    """Make an empty folder where there is none, in whatever store it lies."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote, in whatever store it lies."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more, each just as ``cut_lineage`` returned it."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove_folder(table.sparkSession, folder)


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from there.

    Later steps read the table: they repeat no work when an executor is lost, take only
    the columns they use, and know its size when they choose a join.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

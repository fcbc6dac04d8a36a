"""Writers: result sets, metric table, sync log."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..operators.metrics import EVENTS, add_folded, fold_events, metric_rows
from ..schemas import ddl
from ..session import cut_lineage, make_folder, remove_folder, scratch_path

#: Partitions of a metric table; larger tables want more of them.
BUCKETS = 16


def write_parts(parts: dict[str, DataFrame], folder: str, kind="parquet") -> None:
    """One data set per part below ``folder``; replaces what is there."""
    for name, df in parts.items():
        df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Save as a catalog table bucketed by ``key``, one file per bucket.

    Contents by ``id`` and metrics by ``content_id`` with the same number of buckets join
    without a shuffle from then on. ``key`` should be unique: a bucket is never split.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_star(contents: DataFrame, metrics: DataFrame, folder: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Contents and metrics as catalog tables below ``folder`` in buckets of the content id."""
    name = f"star_{uuid.uuid4().hex}"
    return (
        write_bucketed(contents, f"{name}_contents", f"{folder}/contents", "id", buckets),
        write_bucketed(metrics, f"{name}_metrics", f"{folder}/content_metrics", "content_id", buckets),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def metric_state(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of each content in the metric table below ``folder``, with their bucket.

    No rows where nothing was written yet. Read it anew after an upsert: that replaces files.
    """
    layout = fold_events(spark.createDataFrame([], ddl(EVENTS))).schema.add("bucket", IntegerType())
    make_folder(spark, folder)
    return spark.read.schema(layout).parquet(folder)


def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics rows of the metric table below ``folder``."""
    return metric_rows(metric_state(spark, folder))


def upsert_metrics(events: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Fold ``events`` into the metric table below ``folder``."""
    upsert_folded(fold_events(events), folder, buckets)


def upsert_folded(folded: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Put folded events on top of the metric table below ``folder``.

    The table is partitioned by a hash of content_id. The batch is written first: a stream
    then evaluates it once, and Spark knows its size. Only the partitions it touches are
    read, joined by key and overwritten; the others stay as they are. The fold keeps the
    newest cell by ``seq``, so a batch that comes again, or late, changes nothing it should
    not. Spark replaces the partitions when all tasks are done, so lost executors cost
    nothing; a driver lost in the middle of that leaves some partitions as before or
    gone, and these are made again from the events. One job at a time may write.
    """
    spark = folded.sparkSession
    bucket = F.pmod(F.xxhash64("content_id"), F.lit(buckets)).cast("int")
    path = scratch_path(spark, "batch")
    batch = cut_lineage(folded.withColumn("bucket", bucket), path)
    # At most ``buckets`` numbers.
    touched = [row["bucket"] for row in batch.select("bucket").distinct().collect()]
    if touched:
        before = metric_state(spark, folder).where(F.col("bucket").isin(touched)).drop("bucket")
        state = add_folded(before, batch.drop("bucket")).withColumn("bucket", bucket)
        writer = state.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
        writer.option("partitionOverwriteMode", "dynamic").parquet(folder)
    remove_folder(spark, path)

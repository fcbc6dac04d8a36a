"""Readers with declared schemas: nothing is inferred."""

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES, ddl


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One business table stored as parquet at ``path``."""
    return spark.read.schema(ddl(TABLES[table])).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages (page_id, url, html)."""
    return read_table(spark, path, "pages")


def stream_table(spark: SparkSession, folder: str, columns, pattern="*.parquet") -> DataFrame:
    """Parquet files of ``folder`` as a stream; ``columns`` is DDL text or a StructType."""
    return (
        spark.readStream.schema(columns)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )

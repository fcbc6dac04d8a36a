"""Intermediate tables, and their removal."""

from pyspark.sql import DataFrame

from ..session import cut_lineage


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    The driver then collects its garbage, because only that lets Spark remove the shuffle
    files of the step that wrote the table.
    """
    out = cut_lineage(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more, each just as ``stored`` returned it."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

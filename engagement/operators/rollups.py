"""Counts and sums over the catalogue.

Voided contents are counted everywhere: the rollups do not look at content status.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lifecycle import with_project_status
from ..schemas import CREATOR_ACTIVE, INTERACTIONS, PROJECT_RUNNING
from ..session import cut_lineage
from .joins import with_metrics


def _reactions():
    total = F.col(INTERACTIONS[0])
    for name in INTERACTIONS[1:]:
        total = total + F.col(name)
    return total


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Rows of different columns laid over each other by a sum that ignores missing ones."""
    names = [name for part in parts for name in part.columns]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])


def _people(creators, projects, as_of) -> list[DataFrame]:
    return [
        creators.agg(
            F.count("*").alias("influencer_count"),
            F.count_if(F.col("status") == CREATOR_ACTIVE).alias("active_influencer_count"),
        ),
        with_project_status(projects, as_of).agg(
            F.count("*").alias("project_count"),
            F.count_if(F.col("status") == PROJECT_RUNNING).alias("active_project_count"),
            F.count("status_error").alias("status_error_count"),
        ),
    ]


def platform_totals(creators, projects, contents, metrics, as_of) -> DataFrame:
    """One row of totals; every table is scanned once and reduced to one row of its own."""
    counted = contents.agg(F.count("*").alias("content_count"))
    summed = metrics.agg(F.sum("view_count").alias("total_views"), F.sum(_reactions()).alias("total_interactions"))
    return _one_row([*_people(creators, projects, as_of), counted, summed])


def overview_cells(contents: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts and sums by platform and sync status, from which other rollups are added up.

    One scan of either table, one join on the content id, which is unique in both, and one
    aggregation with partial sums; the result has as many rows as there are pairs of
    platform and status. ``n_contents`` counts contents, ``n_metrics`` metrics rows, also
    those of no content, ``views`` those of contents only.
    """
    left = contents.select("id", "platform", F.lit(1).alias("is_content"))
    right = metrics.select("content_id", "sync_status", "view_count", _reactions().alias("reactions"), F.lit(1).alias("is_metrics"))
    both = left.join(right, F.col("id") == F.col("content_id"), "full")
    return both.groupBy("platform", "sync_status").agg(
        F.count("is_content").alias("n_contents"),
        F.count("is_metrics").alias("n_metrics"),
        F.sum(F.when(F.col("is_content") == 1, F.col("view_count"))).alias("views"),
        F.sum("view_count").alias("all_views"),
        F.sum("reactions").alias("all_reactions"),
    )


def totals_of_cells(cells: DataFrame, creators, projects, as_of) -> DataFrame:
    """``platform_totals`` from the rows of ``overview_cells``."""
    summed = cells.agg(
        F.coalesce(F.sum("n_contents"), F.lit(0)).alias("content_count"),
        F.sum("all_views").alias("total_views"),
        F.sum("all_reactions").alias("total_interactions"),
    )
    return _one_row([*_people(creators, projects, as_of), summed])


def platforms_of_cells(cells: DataFrame) -> DataFrame:
    """``platform_rollup`` from the rows of ``overview_cells``."""
    return cells.filter("n_contents > 0").groupBy("platform").agg(
        F.sum("n_contents").alias("content_count"), F.coalesce(F.sum("views"), F.lit(0)).alias("view_count")
    )


def statuses_of_cells(cells: DataFrame) -> DataFrame:
    """``sync_rollup`` from the rows of ``overview_cells``."""
    return cells.filter("n_metrics > 0").groupBy("sync_status").agg(F.sum("n_metrics").alias("content_count"))


def running_projects(projects: DataFrame, as_of) -> DataFrame:
    """Number of projects whose status on ``as_of`` is running, and of unreadable ones."""
    return with_project_status(projects, as_of).agg(
        F.count_if(F.col("status") == PROJECT_RUNNING).alias("active_project_count"),
        F.count("status_error").alias("status_error_count"),
    )


def platform_rollup(contents: DataFrame, metrics: DataFrame) -> DataFrame:
    """Contents and views per platform."""
    return (
        with_metrics(contents.alias("c"), metrics)
        .groupBy(F.col("c.platform").alias("platform"))
        .agg(
            F.count("*").alias("content_count"),
            F.coalesce(F.sum("m.view_count"), F.lit(0)).alias("view_count"),
        )
    )


def sync_rollup(metrics: DataFrame) -> DataFrame:
    """Metrics rows per sync status; contents without a metrics row are not in it."""
    return metrics.groupBy("sync_status").agg(F.count("*").alias("content_count"))


def ranked(rollup: DataFrame, *measures) -> DataFrame:
    """Largest first by ``measures``; the group key decides between equals."""
    key = [name for name in rollup.columns if name not in measures]
    return rollup.orderBy(*[F.col(m).desc() for m in measures], *key)


def with_position(ordered: DataFrame) -> DataFrame:
    """``ordered`` (the result of an orderBy) with each row's place, from 1, as ``position``.

    Sorted rows lie in range partitions, one after the other. They are written out with
    partition and running number, and the rows of the partitions before are added: one
    row per partition is summed up, never all rows in one task.
    """
    number = F.monotonically_increasing_id()
    rows = cut_lineage(ordered.withColumn("part", F.spark_partition_id()).withColumn("number", number))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    position = F.col("before") + F.col("number") - F.col("first") + 1
    return rows.join(parts, "part").withColumn("position", position).drop("part", "number", "first", "before")


def row_count(df: DataFrame, name="row_count") -> DataFrame:
    return df.agg(F.count("*").alias(name))

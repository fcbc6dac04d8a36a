"""The four parts of the overview."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import interactions_or_zero
from ..operators.joins import star
from ..operators.rollups import overview_cells, platforms_of_cells, ranked, statuses_of_cells, totals_of_cells
from ..schemas import RECENT_ROWS, SYNC_PENDING
from ..session import cut_lineage


def latest_ids(contents, creators, rows: int) -> DataFrame:
    """(id, published_at) of the ``rows`` latest contents whose creator exists.

    The newest ids are taken first, on three narrow columns and without a shuffle, and
    their creators looked up. While too few have one, twice as many are taken; that goes
    on for as long as newer contents without a creator fill the list, or until it holds
    all contents.
    """
    newest = [F.col("published_at").desc(), F.col("id").desc()]
    taken = rows
    while True:
        some = cut_lineage(contents.select("id", "published_at", "influencer_id").orderBy(*newest).limit(taken))
        wanted = some.select(F.col("influencer_id").alias("id")).distinct()
        there = cut_lineage(creators.select("id").join(wanted, "id", "left_semi").distinct())
        known = some.join(there.withColumnRenamed("id", "influencer_id"), "influencer_id", "left_semi")
        counted = known.agg(F.count("*").alias("n")).first()["n"]
        if counted >= rows or some.count() < taken:
            return cut_lineage(known.select("id", "published_at").orderBy(*newest).limit(rows))
        taken *= 2


def recent_contents(contents, creators, projects, metrics, rows=RECENT_ROWS) -> DataFrame:
    """Latest contents by ``published_at``, then id, with names and counters.

    All but the ids of the latest is scanned for these few ids instead of being shuffled.
    They are written out, so that Spark knows how few they are.
    """
    newest = [F.col("published_at").desc(), F.col("id").desc()]
    top = latest_ids(contents, creators, rows)

    def only(table, key, ids):
        return table.join(cut_lineage(ids.toDF(key)), key, "left_semi")

    latest = cut_lineage(
        only(contents, "id", top.select("id")).select(
            "id", "title", "platform", "published_at", "influencer_id", "project_id"
        )
    )
    return (
        star(
            latest,
            only(creators, "id", latest.select("influencer_id")),
            only(projects, "id", latest.select("project_id")),
            only(metrics, "content_id", latest.select("id")),
        )
        .select(
            "c.id",
            "c.title",
            "c.platform",
            "c.published_at",
            F.col("i.name").alias("influencer_name"),
            F.coalesce("p.name", F.lit("")).alias("project_name"),
            F.coalesce("m.view_count", F.lit(0)).alias("view_count"),
            interactions_or_zero("m.").alias("interaction_count"),
            F.coalesce("m.sync_status", F.lit(SYNC_PENDING)).alias("sync_status"),
        )
        .orderBy(*newest)
    )


@dataclass(frozen=True)
class Dashboard:
    totals: DataFrame
    recent_contents: DataFrame
    platform_distribution: DataFrame
    sync_distribution: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def dashboard(creators, projects, contents, metrics, as_of) -> Dashboard:
    """All parts; totals and both distributions come from one pass over contents and metrics."""
    cells = cut_lineage(overview_cells(contents, metrics))
    return Dashboard(
        totals=totals_of_cells(cells, creators, projects, as_of),
        recent_contents=recent_contents(contents, creators, projects, metrics),
        platform_distribution=ranked(platforms_of_cells(cells), "content_count", "view_count"),
        sync_distribution=ranked(statuses_of_cells(cells), "content_count"),
    )

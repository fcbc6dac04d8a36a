"""Filtered searches, bulk look-up and result counts."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lifecycle import with_project_status
from ..functions.numbers import interactions
from ..functions.text import whole_number
from ..operators.filters import equals, has_tag, in_range, linked_to, matches_keyword, where
from ..operators.joins import star, with_creators, with_metrics
from ..operators.keyfilter import sieve
from ..schemas import COUNTERS, CREATORS, PROJECTS
from ..session import cut_lineage


@dataclass(frozen=True)
class CreatorSearch:
    keyword: str = ""
    platform: str = ""
    category: str = ""
    owner: str = ""
    followers_min: int | str | None = None
    followers_max: int | str | None = None
    #: A whole tag, looked up in the array column ``tags`` that ``with_tags`` makes.
    tag: str = ""

    def matching(self, creators: DataFrame) -> DataFrame:
        return where(
            creators,
            matches_keyword(self.keyword, "name"),
            equals(F.col("platform"), self.platform),
            matches_keyword(self.category, "category"),
            has_tag("tags", self.tag),
            matches_keyword(self.owner, "owner"),
            in_range(F.col("followers_count"), self.followers_min, self.followers_max, "followers"),
        )


@dataclass(frozen=True)
class ProjectSearch:
    as_of: str
    keyword: str = ""
    status: str = ""
    owner: str = ""

    def matching(self, projects: DataFrame) -> DataFrame:
        """Projects with their status on ``as_of`` in place of the stored one.

        A project with unreadable dates has a NULL status and a ``status_error``.
        """
        found = where(
            projects,
            matches_keyword(self.keyword, "name", "project_code"),
            matches_keyword(self.owner, "owner"),
        )
        return where(with_project_status(found, self.as_of), equals(F.col("status"), self.status))


@dataclass(frozen=True)
class ContentSearch:
    keyword: str = ""
    platform: str = ""
    project_id: int | str | None = None
    views_min: int | str | None = None
    views_max: int | str | None = None
    interactions_min: int | str | None = None
    interactions_max: int | str | None = None

    def content_conditions(self) -> list[Column | None]:
        return [
            equals(F.col("c.platform"), self.platform),
            linked_to(F.col("c.project_id"), self.project_id),
        ]

    def keyword_condition(self) -> Column | None:
        return matches_keyword(self.keyword, "c.title", "c.content_url", "i.name")

    def metric_conditions(self) -> list[Column | None]:
        views = F.col("m.view_count")
        return [
            in_range(views, self.views_min, self.views_max, "views", missing_is_zero=True),
            in_range(
                interactions("m."), self.interactions_min, self.interactions_max, "interactions"
            ),
        ]


def newest_first(df: DataFrame) -> DataFrame:
    """Sort for display; leave it out when the rows go into another job."""
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc())


def search_creators(creators: DataFrame, search: CreatorSearch) -> DataFrame:
    rows = search.matching(creators).select(*CREATORS)
    return newest_first(rows.withColumn("followers_count", F.coalesce("followers_count", F.lit(0))))


def search_projects(projects: DataFrame, search: ProjectSearch) -> DataFrame:
    return newest_first(search.matching(projects).select(*PROJECTS, "status_error"))


def content_columns() -> list[Column]:
    """The 26 columns of a content list plus ``interaction_count``, over the star join.

    Missing counters are shown as 0; the other metrics columns stay NULL.
    """
    of_content = [
        "id", "title", "influencer_id", "project_id", "platform", "content_url",
        "canonical_url", "platform_content_id", "published_at", "content_type", "owner",
        "status", "remark", "created_at", "updated_at",
    ]
    of_metrics = ["data_source", "sync_status", "last_sync_at", "failed_reason"]
    return [
        *[F.col(f"c.{name}") for name in of_content],
        F.col("i.name").alias("influencer_name"),
        F.coalesce("p.name", F.lit("")).alias("project_name"),
        *[F.coalesce(f"m.{name}", F.lit(0)).alias(name) for name in COUNTERS],
        *[F.col(f"m.{name}") for name in of_metrics],
        interactions("m.").alias("interaction_count"),
    ]


def content_details(contents, creators, projects, metrics) -> DataFrame:
    return star(contents, creators, projects, metrics).select(*content_columns())


def matching_contents(contents, creators, projects, metrics, search: ContentSearch) -> DataFrame:
    rows = star(contents, creators, projects, metrics)
    return where(
        rows, *search.content_conditions(), search.keyword_condition(), *search.metric_conditions()
    ).select(*content_columns())


def search_contents(contents, creators, projects, metrics, search: ContentSearch) -> DataFrame:
    return newest_first(matching_contents(contents, creators, projects, metrics, search))


def count_contents(contents, creators, metrics, search: ContentSearch) -> DataFrame:
    """Number of rows ``search_contents`` finds.

    Projects never change the number, and metrics are joined only if a filter reads them.
    """
    rows = where(contents.alias("c"), *search.content_conditions())
    if any(condition is not None for condition in search.metric_conditions()):
        rows = where(with_metrics(rows, metrics), *search.metric_conditions())
    rows = where(with_creators(rows, creators), search.keyword_condition())
    return rows.agg(F.count("*").alias("row_count"))


def lookup_contents(keys: DataFrame, contents, creators, projects, metrics, key_col="key") -> DataFrame:
    """One row per requested key: ``lookup`` is ok, not_found or bad_id, then the detail.

    Contents and metrics are cut down to the requested ids before the star join: a short
    list of keys is broadcast, for a long one a Bloom filter drops most other rows where
    they are scanned. Neither table is shuffled whole.
    """
    wanted = keys.select(key_col, whole_number(F.col(key_col)).alias("wanted_id"))
    ids = cut_lineage(wanted.select("wanted_id").filter("wanted_id is not null").distinct())

    def asked(table, id_col):
        return sieve(table, F.col(id_col), ids, "wanted_id").join(ids, F.col(id_col) == F.col("wanted_id"), "left_semi")

    contents, metrics = asked(contents, "id"), asked(metrics, "content_id")
    return _answer(wanted, content_details(contents, creators, projects, metrics))


def lookup_creators(keys: DataFrame, creators, key_col="key") -> DataFrame:
    wanted = keys.select(key_col, whole_number(F.col(key_col)).alias("wanted_id"))
    return _answer(wanted, creators.select(*CREATORS))


def lookup_projects(keys: DataFrame, projects, as_of, key_col="key") -> DataFrame:
    wanted = keys.select(key_col, whole_number(F.col(key_col)).alias("wanted_id"))
    return _answer(wanted, with_project_status(projects.select(*PROJECTS), as_of))


def _answer(wanted: DataFrame, details: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("wanted_id").isNull(), "bad_id")
        .when(F.col("id").isNull(), "not_found")
        .otherwise("ok")
    )
    return (
        wanted.join(details, F.col("wanted_id") == F.col("id"), "left")
        .withColumn("lookup", state)
        .drop("wanted_id")
    )

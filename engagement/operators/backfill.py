"""Forward migration of older extracts to the current layout."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import CONTENT_ID_RULES, with_canonical_url, with_content_id
from ..schemas import (
    CONTENT_METRICS,
    CONTENTS,
    CREATOR_ACTIVE,
    CREATORS,
    DEFAULTS,
    LEGACY_CREATOR_STATUSES,
    PROJECT_ARCHIVED,
    PROJECT_ARCHIVED_INPUTS,
    PROJECTS,
    TABLES,
)
from ..session import cut_lineage


def with_missing_columns(df: DataFrame, table: str, required) -> DataFrame:
    """Add the columns of ``table`` the extract lacks, with their defaults."""
    layout, defaults = TABLES[table], DEFAULTS.get(table, {})
    absent = [name for name in layout if name not in df.columns]
    lost = [name for name in absent if name in required]
    if lost:
        raise ValueError(f"extract lacks {', '.join(lost)}")
    filled = {
        name: F.lit(defaults.get(name, "" if layout[name] == "string" else 0)).cast(layout[name])
        for name in absent
    }
    return df.withColumns(filled) if filled else df


def read_extracts(spark: SparkSession, folder: str, table: str, required, legacy=None) -> DataFrame:
    """Parquet extracts of several ages in one folder, in one read, as one layout.

    A file of an older age lacks columns. Where the columns of all files are merged those
    come as NULL, though a column added later holds its default for the rows that were
    there before. One narrow aggregation counts the values of each column by file; a column
    without any value in a file is taken as missing there and gets its default, a NULL
    elsewhere stays. Only ``project_id`` and ``legacy`` columns (name to type), which the
    migration reads and the layout has no more, stay NULL. A file with rows that lacks a
    ``required`` column is refused. The counts are one row for each file.
    """
    layout, defaults = TABLES[table], DEFAULTS.get(table, {})
    merged = spark.read.option("mergeSchema", "true").parquet(folder)
    absent = [name for name in layout if name not in merged.columns and name not in required]
    kept = [name for name in merged.columns if name in layout or name in (legacy or {})]
    rows = merged.select(*kept, F.col("_metadata.file_path").alias("file"))
    later = [name for name in kept if name in layout and name not in required and name != "project_id"]
    counts = rows.groupBy("file").agg(*[F.count(name).alias(f"n_{name}") for name in kept])
    counts = cut_lineage(counts)
    lost = [name for name in required if name not in kept]
    holes = F.lit(False)
    for name in set(required) - set(lost) - {"project_id"}:
        holes = holes | (F.col(f"n_{name}") == 0)
    bad = [row["file"] for row in counts.filter(holes).limit(1).collect()]
    if lost or bad:
        raise ValueError(f"extract lacks {', '.join(lost) or 'a required column: ' + bad[0]}")

    def default(name):
        return F.lit(defaults.get(name, "" if layout[name] == "string" else 0)).cast(layout[name])

    filled = {name: F.when(F.col(f"n_{name}") == 0, default(name)).otherwise(F.col(name).cast(layout[name])) for name in later}
    rows = rows.join(counts, "file").withColumns(filled | {name: default(name) for name in absent})
    old = [F.col(name).cast(kind).alias(name) if name in kept else F.lit(None).cast(kind).alias(name) for name, kind in (legacy or {}).items()]
    return rows.select(*layout, *old)


def migrate_creators(old: DataFrame, now: str) -> DataFrame:
    """Old creator extracts: followers copied, old statuses made active, update time filled."""
    rows = with_missing_columns(old, "creators", ("id", "name", "platform"))
    followers = F.col("followers_count")
    if "followers" in old.columns:
        followers = F.when(
            (followers == 0) & F.col("followers").isNotNull(), F.col("followers").cast("bigint")
        ).otherwise(followers)
    status = F.col("status")
    active = status.isNull() | (status == "") | status.isin(*LEGACY_CREATOR_STATUSES)
    return rows.withColumns(
        {
            "followers_count": followers,
            "status": F.when(active, CREATOR_ACTIVE).otherwise(status),
            "updated_at": F.coalesce(
                F.nullif(F.col("updated_at"), F.lit("")), F.col("created_at"), F.lit(now)
            ),
        }
    ).select(*CREATORS)


def migrate_projects(old: DataFrame) -> DataFrame:
    rows = with_missing_columns(old, "projects", ("id", "name"))
    status = F.col("status")
    archived = status.isin(*PROJECT_ARCHIVED_INPUTS)
    return rows.withColumn(
        "status", F.when(archived, PROJECT_ARCHIVED).otherwise(status)
    ).select(*PROJECTS)


def migrate_contents(old: DataFrame, rules=CONTENT_ID_RULES) -> DataFrame:
    """Fill canonical link and content id where they are missing, keep them elsewhere."""
    rows = with_missing_columns(
        old, "contents", ("id", "influencer_id", "project_id", "platform", "content_url")
    )
    rows = with_canonical_url(rows, target="_canonical")
    rows = with_content_id(rows, rules, canonical="_canonical", target="_content_id")
    blank = F.lit("")
    return (
        rows.withColumn("canonical_url", F.coalesce(F.nullif("canonical_url", blank), "_canonical"))
        .withColumn(
            "platform_content_id", F.coalesce(F.nullif("platform_content_id", blank), "_content_id")
        )
        .select(*CONTENTS)
    )


def migrate_metrics(old: DataFrame) -> DataFrame:
    return with_missing_columns(old, "content_metrics", ("content_id",)).select(*CONTENT_METRICS)

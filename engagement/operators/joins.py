"""Joins of the content star and look-ups against stored rows.

No side is broadcast by hint: Spark broadcasts a dimension when its size is below
``spark.sql.autoBroadcastJoinThreshold``. Beyond it the join shuffles, and adaptive
execution splits the shuffle partition of a hot (or NULL) key on the many-rows side.
That is always enough here because the other side has one row per key, either by the
uniqueness of ids or by an aggregation just before the join.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import cut_lineage
from .keyfilter import sieve


def with_creators(df: DataFrame, creators: DataFrame) -> DataFrame:
    """Creator (alias i) of each content (alias c); contents without one are dropped."""
    return df.join(creators.alias("i"), F.col("c.influencer_id") == F.col("i.id"), "inner")


def with_projects(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Optional project (alias p) of each content (alias c)."""
    return df.join(projects.alias("p"), F.col("c.project_id") == F.col("p.id"), "left")


def with_metrics(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Optional metrics row (alias m) of each content (alias c)."""
    return df.join(metrics.alias("m"), F.col("c.id") == F.col("m.content_id"), "left")


def star(contents, creators, projects, metrics) -> DataFrame:
    """Contents with their creator, and their project and metrics where there are any.

    Metrics come first: tables bucketed by content id join without a shuffle, a hot
    creator's contents lying in all buckets, and a filter on a counter cuts the rows down
    before the other joins.
    """
    return with_creators(with_projects(with_metrics(contents.alias("c"), metrics), projects), creators)


def missing_references(contents, creators, projects) -> DataFrame:
    """Contents whose creator or project id is not stored, with the first reason."""
    checked = (
        contents.alias("c")
        .join(
            creators.select(F.col("id").alias("creator_key")),
            F.col("c.influencer_id") == F.col("creator_key"),
            "left",
        )
        .join(
            projects.select(F.col("id").alias("project_key")),
            F.col("c.project_id") == F.col("project_key"),
            "left",
        )
    )
    reason = F.when(F.col("creator_key").isNull(), "creator_not_found").when(
        F.col("c.project_id").isNotNull() & F.col("project_key").isNull(), "project_not_found"
    )
    return checked.select("c.*", reason.alias("reason")).filter("reason is not null")


def stored_with_keys_of(incoming: DataFrame, stored: DataFrame, keys) -> DataFrame:
    """Stored rows whose ``keys`` are filled and occur in the incoming rows.

    The keys of the batch are written, so that Spark knows their size: a small batch is
    broadcast, and for a big one a Bloom filter drops most other stored rows at the scan.
    """
    filled = " and ".join(f"`{key}` <> ''" for key in keys)
    wanted = cut_lineage(incoming.filter(filled).select(*keys).distinct())
    hashes = wanted.select(F.xxhash64(*keys).alias("hash"))
    return sieve(stored, F.xxhash64(*keys), hashes, "hash").join(wanted, list(keys), "left_semi")


def stored_duplicates(incoming, stored, keys, exclude_self=False, id_col="id") -> DataFrame:
    """Incoming rows whose ``keys`` are all equal to those of a stored row.

    Rows with an empty or NULL key part never collide. With ``exclude_self`` the row stored under
    the incoming id does not count. The stored table is cut down to the keys of the
    batch (without a shuffle if the batch is small enough to broadcast) and to one row
    per key, so a hot key costs one look-up and not a list of partners.
    """
    seen = (
        stored_with_keys_of(incoming, stored, keys)
        .groupBy(*keys)
        .agg(F.min(id_col).alias("first_stored"), F.max(id_col).alias("last_stored"))
    )
    if not exclude_self:
        return incoming.join(seen, list(keys), "left_semi")
    # Another row holds the key unless the only one is the incoming row itself.
    i, s = incoming.alias("i"), seen.alias("s")
    same_key = F.lit(True)
    for key in keys:
        same_key = same_key & (F.col(f"i.{key}") == F.col(f"s.{key}"))
    other = (F.col("first_stored") != F.col(f"i.{id_col}")) | (
        F.col("last_stored") != F.col(f"i.{id_col}")
    )
    return i.join(s, same_key & other, "left_semi")


def creator_directory(creators: DataFrame) -> DataFrame:
    """One row per way to name a creator: (scope, kind, text) -> creator_id.

    ``scope`` is a platform, or ``''`` for all of them. Among creators sharing a text the
    newest wins (``created_at``, then ``id``), as in the list the names are picked from.
    A label ``name / account_id`` and a plain name share the kind ``text``: the label
    winner is kept apart because it goes first.

    Entries are dealt out by their key before they are aggregated. The newest is told by a
    text, so Spark sorts the entries of a task, and a file of few bytes has many.
    """
    label = F.concat(
        "name", F.when(F.col("account_id") != "", F.concat(F.lit(" / "), "account_id")).otherwise("")
    )
    entries = F.array(
        F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("text")),
        F.struct(F.lit("label").alias("kind"), label.alias("text")),
        F.struct(F.lit("name").alias("kind"), F.col("name").alias("text")),
    )
    newest = F.struct("created_at", "id")
    named = (
        creators.select(
            newest.alias("newest"),
            F.explode(F.array(F.lit(""), "platform")).alias("scope"),
            entries.alias("entries"),
        )
        .select("newest", "scope", F.explode("entries").alias("entry"))
        .select("newest", "scope", "entry.*")
    )
    def best(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("newest")))["id"]

    by_id = F.when(F.col("kind") == "id", "id").otherwise("text")
    named = named.withColumn("by", by_id).repartition("scope", "by", "text")
    return named.groupBy("scope", "by", "text").agg(
        F.coalesce(best("id"), best("label"), best("name")).alias("creator_id")
    )


def resolve_creators(references: DataFrame, creators: DataFrame) -> DataFrame:
    """Add ``resolved_id`` to references of (platform, creator_id, creator_text).

    A given id decides alone (and must be on the platform, if one is given). Otherwise
    the text is compared with the labels, then with the names.
    """
    has_id = F.coalesce(F.col("creator_id") != 0, F.lit(False))
    lookups = (
        references.withColumn("scope", F.coalesce("platform", F.lit("")))
        .withColumn("by", F.when(has_id, "id").otherwise("text"))
        .withColumn(
            "text",
            F.when(has_id, F.col("creator_id").cast("string")).otherwise(strip(F.col("creator_text"))),
        )
    )
    directory = creator_directory(creators).withColumnRenamed("creator_id", "resolved_id")
    return lookups.join(directory, ["scope", "by", "text"], "left").drop("scope", "by", "text")

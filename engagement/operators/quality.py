"""Record validation. The reason is the first rule a record breaks, NULL if it is accepted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contacts
from ..functions.lifecycle import with_project_status
from ..functions.links import with_canonical_url, with_content_id
from ..functions.tags import clean_tags, tag_list
from ..functions.text import or_default
from ..schemas import (
    CONTENT_NORMAL,
    CONTENT_STATUSES,
    CONTENT_TYPE_DEFAULT,
    CONTENT_TYPES,
    COUNTERS,
    CREATOR_ACTIVE,
    CREATOR_STATUSES,
    PLATFORMS,
    PROJECT_AUTO,
    PROJECT_STATUS_INPUTS,
    SOURCE_MANUAL,
    SYNC_PENDING,
)
from ..sources.records import is_blank, is_present, number_value, read_fields
from ..session import cut_lineage
from .identity import deduplicate_incoming, identity_keys, refused_updates
from .joins import stored_with_keys_of


def _first_reason(*rules):
    """Reason of the first rule that holds, after any reason the parser already gave."""
    checks = [F.when(F.coalesce(holds, F.lit(False)), reason) for reason, holds in rules]
    return F.coalesce(F.col("reason"), *checks)


def _id_of(df: DataFrame) -> list[str]:
    return ["id"] if "id" in df.columns else []


def check_creators(records: DataFrame) -> DataFrame:
    """Creator records by the rules that need no other row."""
    texts = (
        "name", "platform", "account_id", "profile_url", "category", "wechat", "phone", "email",
        "other_contact", "owner", "status", "remark",
    )
    # The old field name counts only where the new one is not named at all.
    named = is_present("followers_count")
    rows = (
        read_fields(records, texts, ("followers_count", "followers"))
        .select(
            "seq",
            *_id_of(records),
            "reason",
            *texts,
            F.when(named, number_value("followers_count"))
            .otherwise(number_value("followers"))
            .alias("followers"),
            F.when(named, is_blank("followers_count"))
            .otherwise(is_blank("followers"))
            .alias("followers_blank"),
        )
        .withColumns(
            {
                "status": or_default(F.col("status"), CREATOR_ACTIVE),
                "tags": clean_tags(F.col("category")),
                "phone": contacts.phone(F.col("phone")),
                "email": contacts.email(F.col("email")),
                "profile": contacts.profile_url(F.col("profile_url"), F.col("platform")),
            }
        )
    )
    reason = F.coalesce(
        _first_reason(
            ("category_unknown", F.col("tags.unknown_tag").isNotNull()),
            ("name_empty", F.col("name") == ""),
            ("platform_empty", F.col("platform") == ""),
            ("platform_unknown", ~F.col("platform").isin(*PLATFORMS)),
            ("status_unknown", ~F.col("status").isin(*CREATOR_STATUSES)),
            ("followers_not_a_number", ~F.col("followers_blank") & F.col("followers").isNull()),
            ("followers_negative", F.col("followers") < 0),
        ),
        "profile.reason",
        "phone.reason",
        "email.reason",
    )
    return rows.select(
        "seq",
        *_id_of(rows),
        "name",
        "platform",
        "account_id",
        F.col("profile.value").alias("profile_url"),
        F.col("tags.value").alias("category"),
        F.coalesce("followers", F.lit(0)).alias("followers_count"),
        "wechat",
        F.col("phone.value").alias("phone"),
        F.col("email.value").alias("email"),
        "other_contact",
        "owner",
        "status",
        "remark",
        reason.alias("reason"),
    )


def check_projects(records: DataFrame, as_of) -> DataFrame:
    """Project records by the rules that need no other row; the status is the one on ``as_of``."""
    texts = ("name", "project_code", "status", "owner", "start_date", "end_date", "description")
    rows = (
        read_fields(records, texts)
        .withColumn("status", or_default(F.col("status"), PROJECT_AUTO))
        .withColumn("given_status", F.col("status"))
    )
    rows = with_project_status(rows, as_of)
    reason = F.coalesce(
        _first_reason(
            ("name_empty", F.col("name") == ""),
            ("status_unknown", ~F.col("given_status").isin(*PROJECT_STATUS_INPUTS)),
        ),
        "status_error",
    )
    return rows.select(
        "seq",
        *_id_of(rows),
        "name",
        "project_code",
        "status",
        "owner",
        "start_date",
        "end_date",
        "description",
        reason.alias("reason"),
    )


def check_contents(records: DataFrame, creators: DataFrame, projects: DataFrame) -> DataFrame:
    """Content records by their own rules and the stored creators and projects.

    The platform of a content is the one of its creator, whatever the record says.
    """
    texts = {
        "title": "", "content_url": "", "published_at": "", "content_type": CONTENT_TYPE_DEFAULT,
        "owner": "", "status": CONTENT_NORMAL, "remark": "", "data_source": SOURCE_MANUAL,
        "sync_status": SYNC_PENDING,
    }
    numbers = ("influencer_id", "project_id", *COUNTERS)
    rows = (
        read_fields(records, texts, numbers)
        .select(
            "seq",
            *_id_of(records),
            "reason",
            *texts,
            *[number_value(name).alias(name) for name in numbers],
            *[is_blank(name).alias(f"{name}_blank") for name in numbers],
        )
        .withColumns({name: or_default(F.col(name), given) for name, given in texts.items()})
    )
    linked = rows.join(
        creators.select(F.col("id").alias("creator_key"), "platform"),
        F.col("influencer_id") == F.col("creator_key"),
        "left",
    ).join(
        projects.select(F.col("id").alias("project_key")),
        F.col("project_id") == F.col("project_key"),
        "left",
    )

    def unreadable(name):
        return ~F.col(f"{name}_blank") & F.col(name).isNull()

    counter_rules = [
        rule
        for name in COUNTERS
        for rule in (
            (f"{name}_not_a_number", unreadable(name)),
            (f"{name}_negative", F.col(name) < 0),
        )
    ]
    reason = _first_reason(
        ("creator_id_invalid", unreadable("influencer_id") | (F.col("influencer_id") <= 0)),
        ("project_id_invalid", unreadable("project_id") | (F.col("project_id") <= 0)),
        ("title_empty", F.col("title") == ""),
        ("creator_missing", F.col("influencer_id_blank")),
        ("content_url_empty", F.col("content_url") == ""),
        ("published_at_empty", F.col("published_at") == ""),
        ("status_unknown", ~F.col("status").isin(*CONTENT_STATUSES)),
        ("content_type_unknown", ~F.col("content_type").isin(*CONTENT_TYPES)),
        ("creator_not_found", F.col("creator_key").isNull()),
        ("project_not_found", F.col("project_id").isNotNull() & F.col("project_key").isNull()),
        *counter_rules,
    )
    linked = with_canonical_url(linked.withColumn("reason", reason), error="link_error")
    linked = with_content_id(linked).withColumn("reason", F.coalesce("reason", "link_error"))
    return linked.select(
        "seq",
        *_id_of(linked),
        "title",
        "influencer_id",
        "project_id",
        "platform",
        "content_url",
        "canonical_url",
        "platform_content_id",
        "published_at",
        "content_type",
        "owner",
        "status",
        "remark",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in COUNTERS],
        "data_source",
        "sync_status",
        "reason",
    )


IDENTITY = ("platform", "content_url", "canonical_url", "platform_content_id")


def validate_creators(records: DataFrame, stored: DataFrame) -> DataFrame:
    """New creators, entered in ``seq`` order on top of the stored ones."""
    return _reject_repeats(check_creators(records), stored, ["name", "platform"], "duplicate_creator")


def validate_projects(records: DataFrame, stored: DataFrame, as_of) -> DataFrame:
    """New projects, entered in ``seq`` order on top of the stored ones."""
    return _reject_repeats(
        check_projects(records, as_of), stored, ["project_code"], "duplicate_project_code"
    )


def validate_contents(records, creators, projects, stored) -> DataFrame:
    """New contents, entered in ``seq`` order on top of the stored ones."""
    checked = cut_lineage(check_contents(records, creators, projects))
    candidates = checked.filter("reason is null").select("seq", *IDENTITY)
    repeats = deduplicate_incoming(candidates, stored, "seq").filter(~F.col("accepted"))
    return _with_reason(checked, repeats, "duplicate_content")


def validate_creator_updates(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Changed creators: each record replaces the stored row named by its ``id``.

    As in the two below, updates are entered in ``seq`` order: an accepted one takes its
    keys and sets free those its row held before.
    """
    checked = _known_only(cut_lineage(check_creators(records)), stored)
    return _reject_taken(checked, stored, _text_keys("name", "platform"), "duplicate_creator")


def validate_project_updates(records: DataFrame, stored: DataFrame, as_of) -> DataFrame:
    """Changed projects; an empty code never collides."""
    checked = _known_only(cut_lineage(check_projects(records, as_of)), stored)
    return _reject_taken(checked, stored, _text_keys("project_code"), "duplicate_project_code")


def validate_content_updates(records, creators, projects, stored) -> DataFrame:
    """Changed contents; an unknown ``id`` is reported before anything else.

    A content without a creator is not found.
    """
    checked = cut_lineage(check_contents(records, creators, projects))
    with_creator = creators.select(F.col("id").alias("influencer_id"))
    checked = _known_only(checked, stored.join(with_creator, "influencer_id", "left_semi"), first=True)

    def keys(df, id_col, carry=()):
        return identity_keys(df, id_col, carry).drop("hash")

    return _reject_taken(checked, stored, keys, "duplicate_content")


def _text_keys(*columns):
    """Like ``identity_keys``, for one key of text columns that counts if none is empty."""

    def keys(df, id_col, carry=()):
        given = df
        for column in columns:
            given = given.filter(F.col(column) != "")
        return given.select(F.col(id_col).alias("id"), *carry, F.struct(*columns).alias("key"))

    return keys


def _reject_taken(checked: DataFrame, stored: DataFrame, keys, reason) -> DataFrame:
    """Refuse updates whose keys another row holds when their turn comes."""
    checked = cut_lineage(checked)
    valid, held = checked.filter("reason is null"), keys(stored, "id")
    claims = keys(valid, "seq", [F.col("id").alias("target")])
    # An update without a key sets free those of its row.
    nothing = valid.select(F.col("seq").alias("id"), F.col("id").alias("target"))
    claims = claims.unionByName(nothing, allowMissingColumns=True)
    return _with_reason(checked, refused_updates(claims, held), reason)


def _known_only(checked: DataFrame, stored: DataFrame, first=False) -> DataFrame:
    """Refuse updates of rows that are not stored."""
    known = stored.select("id", F.lit(True).alias("known"))
    missing = F.when(F.col("known").isNull(), "not_found")
    order = (missing, "reason") if first else ("reason", missing)
    return checked.join(known, "id", "left").withColumn("reason", F.coalesce(*order)).drop("known")


def _with_reason(checked: DataFrame, refused: DataFrame, reason: str) -> DataFrame:
    """Give ``reason`` to the rows of ``refused`` that have none yet."""
    found = refused.select("seq", F.lit(reason).alias("late_reason"))
    return (
        checked.join(found, "seq", "left")
        .withColumn("reason", F.coalesce("reason", "late_reason"))
        .drop("late_reason")
    )


def _reject_repeats(checked: DataFrame, stored: DataFrame, keys, reason) -> DataFrame:
    """Refuse rows whose key is stored or was accepted earlier in the batch.

    The checked rows are written once, so that records are parsed once. Per key only the
    smallest ``seq`` can win. The winners are found by an aggregation and joined back on
    ``seq``, so that a key held by many records never gathers them.
    """
    checked = cut_lineage(checked)
    valid = checked.filter("reason is null")
    keyed = valid
    for key in keys:
        keyed = keyed.filter(F.col(key) != "")
    winners = (
        keyed.groupBy(*keys)
        .agg(F.min("seq").alias("seq"))
        .join(stored_with_keys_of(keyed, stored.select(*keys), keys), keys, "left_anti")
        .select("seq", F.lit(True).alias("first"))
    )
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & (F.col(key) != "")
    repeat = F.col("reason").isNull() & has_key & F.col("first").isNull()
    return (
        checked.join(winners, "seq", "left")
        .withColumn("reason", F.when(repeat, reason).otherwise(F.col("reason")))
        .drop("first")
    )


def split_by_reason(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the reason column, and refused rows with it."""
    accepted = checked.filter("reason is null").drop("reason")
    return accepted, checked.filter("reason is not null")


def reason_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count("*").alias("record_count")
    )


def normalize_contacts(df: DataFrame) -> DataFrame:
    """Replace phone, email and profile_url by clean values, with a reason column each."""
    out = (
        df.withColumn("_phone", contacts.phone(F.col("phone")))
        .withColumn("_email", contacts.email(F.col("email")))
        .withColumn("_profile_url", contacts.profile_url(F.col("profile_url"), F.col("platform")))
    )
    for name in ("phone", "email", "profile_url"):
        out = out.withColumn(name, F.col(f"_{name}.value")).withColumn(
            f"{name}_reason", F.col(f"_{name}.reason")
        )
    return out.drop("_phone", "_email", "_profile_url")


def contact_counts(normalized: DataFrame) -> DataFrame:
    """Per contact column: rows that are blank, clean and refused."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("contact"),
                F.when(F.col(f"{name}_reason").isNotNull(), "refused")
                .when(F.col(name) == "", "blank")
                .otherwise("clean")
                .alias("state"),
            )
            for name in ("phone", "email", "profile_url")
        ]
    )
    return (
        normalized.select(F.explode(entries).alias("e"))
        .groupBy("e.contact")
        .agg(*[F.count_if(F.col("e.state") == s).alias(f"{s}_count") for s in ("blank", "clean", "refused")])
    )


def normalize_tags(df: DataFrame, col="category") -> DataFrame:
    """Clean a joined tag column; ``unknown_tag`` holds the first tag outside the list."""
    return (
        df.withColumn("_tags", clean_tags(F.col(col)))
        .withColumn(col, F.col("_tags.value"))
        .withColumn("unknown_tag", F.col("_tags.unknown_tag"))
        .drop("_tags")
    )


def with_tags(df: DataFrame, col="category") -> DataFrame:
    """Add the array ``tags``: the different tags of a joined column, in their order.

    Stored once, it answers whole-tag filters without splitting texts again.
    """
    return df.withColumn("tags", F.array_distinct(tag_list(F.col(col))))

"""Display form of the lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import tag_list
from ..schemas import SYNC_PENDING, TAG_JOINER

# Texts shown where a value is missing.
NO_ACCOUNT = "未填写账号 ID"
NO_DESCRIPTION = "未填写项目说明"
NO_TYPE = "未填写类型"


def _filled(col) -> Column:
    return F.nullif(F.coalesce(col, F.lit("")), F.lit(""))


def or_dash(col) -> Column:
    return F.coalesce(_filled(col), F.lit("-"))


def initial(col) -> Column:
    return F.upper(F.substring(F.coalesce(_filled(col), F.lit("?")), 1, 1))


def truncated(col, width=16) -> Column:
    text = F.coalesce(col, F.lit(""))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def grouped_number(col) -> Column:
    return F.format_number(F.coalesce(col, F.lit(0)), 0)


def minute(col) -> Column:
    """Time to the minute, date and time set apart by a blank."""
    spaced = F.regexp_replace(col, r"^([^T]*)T", "$1 ")
    return F.coalesce(F.substring(_filled(spaced), 1, 16), F.lit("-"))


def primary_contact() -> Column:
    columns = ("wechat", "phone", "email", "other_contact")
    return F.coalesce(*[_filled(F.col(name)) for name in columns], F.lit("-"))


def creator_label() -> Column:
    """Name, and the account id after a slash if there is one."""
    account = _filled(F.col("account_id"))
    return F.concat("name", F.coalesce(F.concat(F.lit(" / "), account), F.lit("")))


def tag_summary(col) -> tuple[Column, Column, Column]:
    """First tag (or a dash), ``+n`` for the others, and all tags joined."""
    tags = tag_list(col)
    hidden = F.size(tags) - 1
    return (
        F.coalesce(F.get(tags, 0), F.lit("-")),
        F.when(hidden > 0, F.concat(F.lit("+"), hidden.cast("string"))).otherwise(""),
        F.array_join(tags, TAG_JOINER),
    )


def creator_report(creators: DataFrame) -> DataFrame:
    first_tag, more_tags, all_tags = tag_summary(F.col("category"))
    return creators.select(
        "id",
        initial(F.col("name")).alias("initial"),
        creator_label().alias("label"),
        "name",
        F.coalesce(_filled(F.col("account_id")), F.lit(NO_ACCOUNT)).alias("account"),
        "platform",
        first_tag.alias("first_tag"),
        more_tags.alias("more_tags"),
        all_tags.alias("all_tags"),
        grouped_number(F.col("followers_count")).alias("followers"),
        or_dash(F.col("owner")).alias("owner"),
        primary_contact().alias("contact"),
        "status",
        minute(F.col("updated_at")).alias("updated"),
    )


def project_report(projects: DataFrame) -> DataFrame:
    """``projects`` with the status of the day already derived."""
    described = _filled(F.col("description"))
    return projects.select(
        "id",
        initial(F.col("name")).alias("initial"),
        truncated(F.col("name"), 10).alias("name"),
        F.when(described.isNull(), NO_DESCRIPTION)
        .otherwise(truncated(described, 12))
        .alias("description"),
        or_dash(F.col("project_code")).alias("project_code"),
        "status",
        or_dash(F.col("owner")).alias("owner"),
        or_dash(F.col("start_date")).alias("start_date"),
        or_dash(F.col("end_date")).alias("end_date"),
        minute(F.col("updated_at")).alias("updated"),
    )


def content_report(details: DataFrame) -> DataFrame:
    """Display form of the rows of ``content_details``."""
    project = _filled(F.col("project_name"))
    return details.select(
        "id",
        initial(F.col("title")).alias("initial"),
        truncated(F.col("title")).alias("title"),
        F.coalesce(_filled(F.col("content_type")), F.lit(NO_TYPE)).alias("content_type"),
        or_dash(F.col("influencer_name")).alias("creator"),
        or_dash(F.col("platform")).alias("platform"),
        F.when(project.isNull(), "-").otherwise(truncated(project, 10)).alias("project"),
        or_dash(F.col("published_at")).alias("published_at"),
        grouped_number(F.col("view_count")).alias("views"),
        grouped_number(F.col("interaction_count")).alias("interactions"),
        F.coalesce(_filled(F.col("sync_status")), F.lit(SYNC_PENDING)).alias("sync_status"),
        minute(F.coalesce(_filled(F.col("last_sync_at")), F.col("updated_at"))).alias("updated"),
    )

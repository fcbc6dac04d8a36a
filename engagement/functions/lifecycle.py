"""Project status as of a day."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    PROJECT_ARCHIVED,
    PROJECT_ARCHIVED_INPUTS,
    PROJECT_ENDED,
    PROJECT_PENDING,
    PROJECT_RUNNING,
)
from .text import strip


def iso_date(text) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD`` as a date; NULL for anything else."""
    shape = F.translate(text, "123456789", "000000000")
    compact = F.concat(text.substr(1, 4), F.lit("-"), text.substr(5, 2), F.lit("-"), text.substr(7, 2))
    return F.when(shape == "0000-00-00", text).when(shape == "00000000", compact).try_cast("date")


def with_project_status(projects: DataFrame, as_of) -> DataFrame:
    """Replace ``status`` by the one on ``as_of``; ``status_error`` tells why there is none.

    Archived projects are never checked further; both end points belong to the run. The
    dates are columns of their own on the way, so that each is read once per row.
    """
    as_of = F.lit(as_of).cast("date")
    start, end = F.col("_start"), F.col("_end")
    archived = F.col("_archived")
    error = (
        F.when(archived, None)
        .when((F.col("_start_text") != "") & start.isNull(), "start_date_invalid")
        .when((F.col("_end_text") != "") & end.isNull(), "end_date_invalid")
        .when(end < start, "end_before_start")
        .cast("string")
    )
    status = (
        F.when(archived, PROJECT_ARCHIVED)
        .when(F.col("status_error").isNotNull(), None)
        .when(as_of < start, PROJECT_PENDING)
        .when(as_of > end, PROJECT_ENDED)
        .otherwise(PROJECT_RUNNING)
    )
    return (
        projects.withColumns(
            {
                "_start_text": strip(F.col("start_date")),
                "_end_text": strip(F.col("end_date")),
                "_archived": F.coalesce(F.col("status").isin(*PROJECT_ARCHIVED_INPUTS), F.lit(False)),
            }
        )
        .withColumns({"_start": iso_date(F.col("_start_text")), "_end": iso_date(F.col("_end_text"))})
        .withColumn("status_error", error)
        .withColumn("status", status)
        .drop("_start_text", "_end_text", "_archived", "_start", "_end")
    )

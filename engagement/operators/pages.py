"""Extraction of engagement counters from saved pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import displayed_count
from ..functions.pagefields import field_text, label_text
from ..functions.text import drop_whitespace
from ..schemas import (
    PAGE_CHALLENGE_WORDS,
    PAGE_FAILURES,
    PAGE_FIELDS,
    PAGE_HOST,
    PAGE_LABELS,
    PAGE_PLATFORM,
)


def supported_page() -> Column:
    return (F.col("platform") == PAGE_PLATFORM) | F.col("url").contains(PAGE_HOST)


def page_metrics(pages: DataFrame, fields=PAGE_FIELDS, labels=PAGE_LABELS, supported=None) -> DataFrame:
    """Add one column per counter and the ``outcome`` of each page.

    ``pages`` has ``url``, ``html`` and ``platform``. Outcomes: ``unsupported`` (another
    platform), ``no_page`` (no text), ``challenge`` (the page asks for a verification),
    ``no_metrics``, ``ok``.
    Counters not found are NULL. ``supported`` replaces the platform test.

    White space is removed only from pages where a field is missing, once per page.
    """
    if supported is None:
        supported = supported_page()
    challenge = F.lit(True)
    for word in PAGE_CHALLENGE_WORDS:
        challenge = challenge & F.col("html").contains(word)
    read = pages.withColumn(
        "_state",
        F.when(~F.coalesce(supported, F.lit(False)), "unsupported")
        .when(F.col("html").isNull(), "no_page")
        .when(challenge, "challenge"),
    )
    readable = F.col("_state").isNull()
    read = read.withColumns(
        {name: F.when(readable, field_text(F.col("html"), names)) for name, names in fields.items()}
    )
    missing = F.lit(False)
    for name in labels:
        missing = missing | F.col(name).isNull()
    read = read.withColumn("_compact", F.when(readable & missing, drop_whitespace(F.col("html"))))
    read = read.withColumns(
        {
            name: F.coalesce(F.col(name), label_text(F.col("_compact"), words))
            for name, words in labels.items()
        }
    )
    read = read.withColumns({name: displayed_count(F.col(name)) for name in fields})
    found = F.coalesce(*[F.col(name) for name in fields])
    outcome = F.coalesce("_state", F.when(found.isNull(), "no_metrics").otherwise("ok"))
    return read.withColumn("outcome", outcome).drop("_state", "_compact")


def sync_events(extracted: DataFrame, event_time) -> DataFrame:
    """Page outcomes as sync events (content_id, seq) for the metric state fold."""
    message = F.create_map(*[F.lit(x) for pair in PAGE_FAILURES.items() for x in pair])
    return extracted.select(
        "content_id",
        "seq",
        F.when(F.col("outcome") == "ok", "sync_ok").otherwise("sync_fail").alias("kind"),
        event_time.alias("event_time"),
        F.lit(None).cast("bigint").alias("view_count"),
        "like_count",
        "comment_count",
        "collect_count",
        F.lit(None).cast("bigint").alias("share_count"),
        F.lit(None).cast("string").alias("data_source"),
        F.lit(None).cast("string").alias("sync_status"),
        F.coalesce(message[F.col("outcome")], F.lit("")).alias("failed_reason"),
    )

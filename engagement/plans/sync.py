"""Synchronization: saved pages read into metric state and log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import sync_log
from ..operators.pages import page_metrics, supported_page, sync_events
from ..schemas import PAGE_FIELDS
from ..session import cut_lineage
from ..sources.sinks import append_log, upsert_metrics


def synced_contents(
    contents: DataFrame, creators: DataFrame, pages: DataFrame, seq: int, event_time: str
) -> DataFrame:
    """One sync event per content, numbered ``seq``, from the latest page saved for its link.

    Pages are reduced to their counters where they are read, and these to the page with
    the largest ``page_id`` of each link before they are joined; page texts are never
    shuffled. A content without a page fails without a reason; one without a creator is
    not found, so it has no event.
    """
    read = page_metrics(pages, supported=F.lit(True)).select(
        "page_id", "url", *PAGE_FIELDS, F.col("outcome").alias("page_outcome")
    )
    latest = F.max(F.struct("page_id", *PAGE_FIELDS, "page_outcome")).alias("page")
    read = read.groupBy("url").agg(latest).select("url", "page.*").drop("page_id")
    known = creators.select(F.col("id").alias("influencer_id"))
    contents = contents.join(known, "influencer_id", "left_semi")
    linked = contents.select(F.col("id").alias("content_id"), "platform", F.col("content_url").alias("url"))
    outcome = (
        F.when(~supported_page(), "unsupported")
        .when(F.col("page_outcome").isNull(), "no_page")
        .otherwise(F.col("page_outcome"))
    )
    extracted = linked.join(read, "url", "left").withColumn("outcome", outcome)
    counters = {name: F.when(F.col("outcome") == "ok", F.col(name)) for name in PAGE_FIELDS}
    return sync_events(
        extracted.withColumns(counters).withColumn("seq", F.lit(seq).cast("bigint")), F.lit(event_time)
    )


def run_sync(contents, creators, pages, folder: str, log_path: str, seq: int, event_time: str) -> None:
    """Read the pages of ``contents``, bring the metric table up to date and append the log."""
    events = cut_lineage(synced_contents(contents, creators, pages, seq, event_time))
    upsert_metrics(events, folder)
    append_log(sync_log(events), log_path)

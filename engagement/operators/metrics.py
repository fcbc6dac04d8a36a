"""Metric state: ordered create, edit and sync events folded into one row per content.

Every column of the state is last-writer-wins on ``seq``, and each event kind writes only
some of the columns. Columns that are always written together share one cell, a struct
that starts with the ``seq`` of its writer; the fold is the maximum of each cell. It is
associative and commutative: it combines before the shuffle (a hot content costs one
partial row per task), takes late and reordered events, and adds to an earlier state.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_default
from ..schemas import (
    CONTENT_METRICS,
    COUNTERS,
    LOG_FAILED,
    LOG_OK,
    SOURCE_MANUAL,
    SOURCE_PAGE,
    SYNC_FAILED,
    SYNC_LOGS,
    SYNC_OK,
    SYNC_PENDING,
)
from ..session import cut_lineage

EVENTS = {
    "content_id": "bigint",
    "seq": "bigint",
    "kind": "string",
    "event_time": "string",
    "view_count": "bigint",
    "like_count": "bigint",
    "comment_count": "bigint",
    "collect_count": "bigint",
    "share_count": "bigint",
    "data_source": "string",
    "sync_status": "string",
    "failed_reason": "string",
}
PAGE_COUNTERS = ("like_count", "comment_count", "collect_count")
CELLS = ("manual", *PAGE_COUNTERS, "last_event", "status", "sync")


def entry_events(accepted: DataFrame, kind: str, event_time: str, id_col="id") -> DataFrame:
    """Accepted content records as ``create`` or ``edit`` events of their metrics."""
    return accepted.select(
        F.col(id_col).alias("content_id"),
        "seq",
        F.lit(kind).alias("kind"),
        F.lit(event_time).alias("event_time"),
        *COUNTERS,
        "data_source",
        "sync_status",
        F.lit("").alias("failed_reason"),
    ).select(*EVENTS)


def _cell(written, **values) -> Column:
    fields = [F.col("seq"), *[value.alias(name) for name, value in values.items()]]
    return F.when(written, F.struct(*fields))


def cells(events: DataFrame) -> DataFrame:
    """The cells each event writes; NULL where it leaves a cell alone."""
    kind = F.col("kind")
    entered = kind.isin("create", "edit")
    synced = kind.isin("sync_ok", "sync_fail")

    def counter(name):
        return F.coalesce(F.col(name), F.lit(0))

    columns = {
        "manual": _cell(
            entered, view_count=counter("view_count"), share_count=counter("share_count")
        ),
        "last_event": _cell(
            F.lit(True),
            data_source=F.when(synced, SOURCE_PAGE).otherwise(
                or_default(F.col("data_source"), SOURCE_MANUAL)
            ),
            updated_at=F.col("event_time"),
        ),
        "status": _cell(
            kind != "edit",
            sync_status=F.when(kind == "sync_ok", SYNC_OK)
            .when(kind == "sync_fail", SYNC_FAILED)
            .otherwise(or_default(F.col("sync_status"), SYNC_PENDING)),
        ),
        "sync": _cell(
            synced,
            last_sync_at=F.col("event_time"),
            failed_reason=F.when(
                kind == "sync_fail", or_default(F.col("failed_reason"), SYNC_FAILED)
            ).otherwise(""),
        ),
    }
    for name in PAGE_COUNTERS:
        extracted = (kind == "sync_ok") & F.col(name).isNotNull()
        columns[name] = _cell(entered | extracted, value=counter(name))
    return events.select("content_id", *[columns[name].alias(name) for name in CELLS])


def fold(written: DataFrame) -> DataFrame:
    """Newest cells per content."""
    return written.groupBy("content_id").agg(*[F.max(name).alias(name) for name in CELLS])


def fold_events(events: DataFrame) -> DataFrame:
    return fold(cells(events))


def add_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """Upsert: ``events`` on top of an earlier state.

    The events are folded and written out first, so Spark knows their size: it broadcasts
    a small batch and passes over the state without a shuffle.
    """
    return add_folded(state, cut_lineage(fold_events(events)))


def add_folded(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert of events folded already; ``batch`` is read three times."""
    newer = batch.withColumnsRenamed({name: f"new_{name}" for name in CELLS})
    merged = state.join(newer, "content_id", "left").select(
        "content_id", *[F.greatest(name, f"new_{name}").alias(name) for name in CELLS]
    )
    touched = state.join(batch, "content_id", "left_semi").select("content_id")
    return merged.unionByName(batch.join(touched, "content_id", "left_anti"))


def metric_rows(state: DataFrame) -> DataFrame:
    """The metrics table of a state, defaults in place of cells never written."""

    def shown(path, default):
        return F.coalesce(F.col(path), F.lit(default)).alias(path.rsplit(".", 1)[1])

    return state.select(
        "content_id",
        shown("manual.view_count", 0),
        *[F.coalesce(F.col(f"{name}.value"), F.lit(0)).alias(name) for name in PAGE_COUNTERS],
        shown("manual.share_count", 0),
        shown("last_event.data_source", SOURCE_MANUAL),
        shown("status.sync_status", SYNC_PENDING),
        shown("sync.last_sync_at", ""),
        F.lit("").alias("next_sync_at"),
        shown("sync.failed_reason", ""),
        shown("last_event.updated_at", ""),
    ).select(*CONTENT_METRICS)


def sync_log(events: DataFrame) -> DataFrame:
    """One log row per sync event, the counters found as JSON text."""
    ok = F.col("kind") == "sync_ok"
    found = [F.concat(F.lit(f'"{name}": '), F.col(name).cast("string")) for name in PAGE_COUNTERS]
    summary = F.concat(F.lit("{"), F.concat_ws(", ", *found), F.lit("}"))
    return events.filter(F.col("kind").isin("sync_ok", "sync_fail")).select(
        "content_id",
        F.lit(SOURCE_PAGE).alias("source"),
        F.when(ok, LOG_OK).otherwise(LOG_FAILED).alias("status"),
        F.col("event_time").alias("started_at"),
        F.col("event_time").alias("finished_at"),
        F.when(ok, summary).otherwise("").alias("raw_summary"),
        F.when(ok, "").otherwise(or_default(F.col("failed_reason"), SYNC_FAILED)).alias("error_message"),
    ).select(*SYNC_LOGS)

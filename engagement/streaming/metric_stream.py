"""Metric state from a stream of create, edit and sync events."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import fold_events, metric_rows, sync_log
from ..sources.sinks import BUCKETS, upsert_folded

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def metric_stream(events: DataFrame) -> DataFrame:
    """Running metrics table of an event stream, for ``update`` or ``complete`` output.

    The same fold as in batch. It orders by ``seq`` and not by arrival, so late events
    need no watermark, and the state is one row per content.
    """
    return metric_rows(fold_events(events))


def start_metric_table(
    events: DataFrame, folder: str, log_path: str, checkpoint: str, buckets: int = BUCKETS
) -> tuple[StreamingQuery, StreamingQuery]:
    """Stream ``events`` into the metric table below ``folder`` and into the sync log.

    The running fold keeps one row per content in RocksDB, on the executors' disks and in
    the checkpoint. In ``update`` mode each micro-batch hands on the contents it changed,
    and these replace their rows in the table. A batch run again after a failure puts the
    same cells there again, so nothing counts twice, whatever else writes to the table in
    between. The log is a file sink, which takes each event once. Both queries read what
    is there and stop; started again on their checkpoint they go on from there.
    """
    # Taken by queries when they start.
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def keep(batch: DataFrame, batch_id: int) -> None:
        upsert_folded(batch, folder, buckets)

    def start(rows: DataFrame, name: str, mode: str):
        writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}")
        return writer.trigger(availableNow=True)

    state = start(fold_events(events), "state", "update").foreachBatch(keep).start()
    log = start(sync_log(events), "log", "append").format("parquet").option("path", log_path).start()
    return state, log

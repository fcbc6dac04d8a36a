"""Metric state: event rules, order independence, partitioned table, stream = batch."""

import random

import pytest
from pyspark.sql import functions as F

from engagement.operators.metrics import EVENTS, add_events, cells, fold, fold_events, metric_rows, sync_log
from engagement.operators.pages import page_metrics, sync_events
from engagement.plans.sync import synced_contents
from engagement.schemas import ddl
from engagement.sources.adapters import Tables
from engagement.sources.sinks import metric_state, metric_table, upsert_metrics
from engagement.streaming.metric_stream import ROCKSDB, metric_stream, start_metric_table


def events(spark, *rows):
    names = list(EVENTS)
    full = [tuple({**dict.fromkeys(names), **row}[n] for n in names) for row in rows]
    return spark.createDataFrame(full, ddl(EVENTS))


def event(seq, kind, **values):
    return {"content_id": 1, "seq": seq, "kind": kind, "event_time": f"t{seq}", **values}


def state_of(spark, *rows):
    return metric_rows(fold_events(events(spark, *rows))).first().asDict()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_edit_keeps_sync_status(spark):
    found = state_of(
        spark, event(1, "create", like_count=5), event(2, "sync_fail"), event(3, "edit", like_count=7)
    )
    assert (found["like_count"], found["sync_status"], found["data_source"]) == (7, "同步失败", "手动")
    assert (found["failed_reason"], found["last_sync_at"], found["updated_at"]) == ("同步失败", "t2", "t3")


def test_sync_sets_only_what_it_found(spark):
    found = state_of(
        spark,
        event(1, "create", view_count=10, like_count=5, comment_count=6, share_count=3),
        event(2, "sync_fail", failed_reason="no page"),
        event(3, "sync_ok", view_count=99, like_count=8, share_count=99),
    )
    assert [found[n] for n in ("view_count", "like_count", "comment_count", "collect_count", "share_count")] == [10, 8, 6, 0, 3]
    assert (found["sync_status"], found["data_source"], found["failed_reason"]) == ("同步成功", "网页解析", "")


def test_sync_without_create_starts_from_defaults(spark):
    found = state_of(spark, event(1, "sync_fail", failed_reason="x"))
    assert (found["view_count"], found["sync_status"], found["failed_reason"]) == (0, "同步失败", "x")
    found = state_of(spark, event(1, "edit", data_source="导入"))
    assert (found["sync_status"], found["data_source"], found["last_sync_at"]) == ("待同步", "导入", "")


def test_order_and_grouping_do_not_matter(spark, folder):
    given = Tables(spark, folder).metric_events()
    expected = rows_of(metric_rows(fold_events(given)))
    shuffled = given.orderBy(F.rand(5)).repartition(3)
    assert rows_of(metric_rows(fold_events(shuffled))) == expected
    late = fold_events(given.filter("seq % 3 = 1"))
    for rest in (2, 0):
        late = add_events(late, given.filter(f"seq % 3 = {rest}"))
    assert rows_of(metric_rows(late)) == expected
    assert rows_of(metric_rows(fold(cells(given)))) == expected


def likes(spark, folder):
    return {r["content_id"]: r["like_count"] for r in metric_table(spark, folder).collect()}


def test_a_batch_that_comes_again_or_late_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "metrics")
    assert metric_table(spark, folder).count() == 0
    first = events(spark, event(1, "create", like_count=1))
    for batch in (first, events(spark, event(3, "edit", like_count=3)), first, events(spark, event(2, "edit", like_count=2)), events(spark)):
        upsert_metrics(batch, folder)
    assert likes(spark, folder) == {1: 3}


def files(folder):
    return {path.parent.name: path.name for path in folder.glob("bucket=*/*.parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    folder = tmp_path / "metrics"
    many = [event(i, "create", like_count=i) | {"content_id": i} for i in range(1, 60)]
    upsert_metrics(events(spark, *many), str(folder), buckets=8)
    before = files(folder)
    upsert_metrics(events(spark, event(100, "edit", like_count=100)), str(folder), buckets=8)
    after = files(folder)
    assert len(before) == len(after) == 8 and sum(before[k] != after[k] for k in before) == 1
    assert likes(spark, str(folder)) == {i: i for i in range(2, 60)} | {1: 100}
    # A look-up of few contents reads their partitions only.
    some = metric_state(spark, str(folder)).where("bucket = 3")
    assert "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def run_stream(arriving, folder, log, checkpoint):
    for query in start_metric_table(arriving, folder, log, checkpoint):
        query.awaitTermination()
        assert query.exception() is None


def test_batches_and_streams_on_one_table_lose_nothing(spark, tmp_path):
    folder, source, log = (str(tmp_path / name) for name in ("metrics", "in", "log"))
    upsert_metrics(events(spark, event(1, "create", like_count=1)), folder)
    for i, checkpoint in enumerate(("cp1", "cp1", "cp2")):
        made = event(10 + i, "sync_ok", like_count=10 + i) | {"content_id": 10 + i}
        events(spark, made).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(ddl(EVENTS)).option("maxFilesPerTrigger", 1).parquet(source)
        run_stream(arriving, folder, f"{log}/{checkpoint}", str(tmp_path / checkpoint))
        # Another job writes between two micro-batches.
        upsert_metrics(events(spark, event(20 + i, "edit", like_count=20 + i)), folder)
    assert likes(spark, folder) == {1: 22, 10: 10, 11: 11, 12: 12}
    assert spark.read.parquet(f"{log}/cp1").count() == 2 and spark.read.parquet(f"{log}/cp2").count() == 3


def test_stream_equals_batch_over_a_restart(spark, folder, tmp_path):
    given = Tables(spark, folder).metric_events()
    expected = rows_of(metric_rows(fold_events(given)))
    order = [0, 1, 2, 3]
    random.Random(3).shuffle(order)
    source, table, log, checkpoint = (str(tmp_path / name) for name in ("in", "metrics", "log", "cp"))
    arriving = spark.readStream.schema(ddl(EVENTS)).option("maxFilesPerTrigger", 1)
    for part in order[:2]:
        given.filter(f"seq % 4 = {part}").coalesce(1).write.mode("append").parquet(source)
    run_stream(arriving.parquet(source), table, log, checkpoint)
    for part in order[2:]:
        given.filter(f"seq % 4 = {part}").coalesce(1).write.mode("append").parquet(source)
    run_stream(arriving.parquet(source), table, log, checkpoint)
    assert rows_of(metric_table(spark, table)) == expected
    assert rows_of(spark.read.parquet(log)) == rows_of(sync_log(given))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ROCKSDB
    # A restart finds nothing new.
    before = files(tmp_path / "metrics")
    run_stream(arriving.parquet(source), table, log, checkpoint)
    assert files(tmp_path / "metrics") == before

    running = metric_stream(arriving.parquet(source)).writeStream.outputMode("complete").format("memory").queryName("running")
    running.option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.table("running")) == expected


def test_a_batch_lost_before_its_end_is_made_up(spark, tmp_path, monkeypatch):
    from engagement.streaming import metric_stream as module

    folder, source, log, checkpoint = (str(tmp_path / name) for name in ("metrics", "in", "log", "cp"))
    put, calls = module.upsert_folded, []

    def dies_once(batch, *where):
        put(batch, *where)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost after the table was written")

    monkeypatch.setattr(module, "upsert_folded", dies_once)
    for i in range(4):
        made = [event(10 * i + k, "edit", like_count=i) | {"content_id": k} for k in range(3)]
        events(spark, *made).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(ddl(EVENTS)).option("maxFilesPerTrigger", 1).parquet(source)
    state, logged = start_metric_table(arriving, folder, log, checkpoint)
    logged.awaitTermination()
    with pytest.raises(Exception, match="lost after"):
        state.awaitTermination()
    run_stream(arriving, folder, log, checkpoint)
    assert likes(spark, folder) == {0: 3, 1: 3, 2: 3} and len(calls) >= 5


def test_the_latest_page_of_a_link_counts_and_contents_need_a_creator(spark):
    contents = spark.createDataFrame(
        [(1, 7, "小红书", "u"), (2, 8, "小红书", "u")], "id bigint, influencer_id bigint, platform string, content_url string"
    )
    creators = spark.createDataFrame([(7,)], "id bigint")
    pages = spark.createDataFrame(
        [(1, "u", '"likes":"5"'), (2, "u", '"likes":"3"')], "page_id bigint, url string, html string"
    )
    found = synced_contents(contents, creators, pages, 9, "now").select("content_id", "like_count").collect()
    assert found == [(1, 3)]


def test_pages_feed_the_state(spark):
    pages = spark.createDataFrame(
        [(1, 1, "小红书", "u", '"likes":"2k"'), (2, 1, "小红书", "u", "小红书验证"), (3, 1, "抖音", "u", "")],
        "content_id bigint, seq bigint, platform string, url string, html string",
    )
    synced = sync_events(page_metrics(pages), F.lit("now"))
    found = {r["content_id"]: r for r in metric_rows(fold_events(synced)).collect()}
    assert (found[1]["like_count"], found[1]["sync_status"]) == (2000, "同步成功")
    assert found[2]["failed_reason"] == "页面可能触发验证或风控，暂时无法自动抓取"
    assert found[3]["failed_reason"] == "当前第一版只支持小红书链接自动同步"
    log = {r["content_id"]: r["raw_summary"] for r in sync_log(synced).collect()}
    assert log[1] == '{"like_count": 2000}' and log[2] == ""

"""Plans stay inside Spark's own operators and scan no more than they need."""

import re

import pytest
from pyspark.sql import functions as F

from engagement.operators import keyfilter
from engagement.operators.backfill import read_extracts
from engagement.operators.filters import has_tag
from engagement.operators.joins import creator_directory, star, stored_with_keys_of, with_metrics
from engagement.operators.keyfilter import key_filter
from engagement.operators.quality import with_tags
from engagement.operators.rollups import overview_cells, platform_totals
from engagement.plans import search
from engagement.plans.dashboard import latest_ids, recent_contents
from engagement.plans.registered import QUERIES
from engagement.schemas import TABLES
from engagement.session import BROADCAST, configure, cut_lineage, shared_folder
from engagement.sources.adapters import AS_OF, Tables
from engagement.sources.records import parse_records
from engagement.sources.sinks import write_bucketed, write_parts, write_star
from engagement.sources.tables import read_table


def plan_of(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def stored(spark, folder, tmp_path_factory):
    """The model tables written out, as a user would have them."""
    t = Tables(spark, folder)
    path = str(tmp_path_factory.mktemp("model"))
    write_parts(
        {"creators": t.creators(), "projects": t.projects(), "contents": t.contents(), "content_metrics": t.metrics()},
        path,
    )
    return {n: read_table(spark, f"{path}/{n}", n) for n in ("creators", "projects", "contents", "content_metrics")}


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_cartesian(name, spark, folder):
    plan = plan_of(QUERIES[name](spark, folder))
    for bad in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_totals_scan_each_table_once(spark, stored):
    plan = plan_of(
        platform_totals(stored["creators"], stored["projects"], stored["contents"], stored["content_metrics"], AS_OF)
    )
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 4
    assert "ReadSchema: struct<status:string>" in plan


def test_recent_contents_take_the_top_before_the_wide_joins(spark, stored):
    seen = []
    import engagement.plans.dashboard as module

    original = module.cut_lineage
    module.cut_lineage = lambda df: seen.append(plan_of(df)) or original(df)
    try:
        found = recent_contents(stored["contents"], stored["creators"], stored["projects"], stored["content_metrics"])
    finally:
        module.cut_lineage = original
    assert "TakeOrderedAndProject" in seen[0] and "title" not in seen[0]
    assert found.count() == 5


def test_filters_and_columns_reach_the_scan(spark, stored):
    wanted = search.ContentSearch(platform="BUILDING", project_id="none", views_min=100)
    plan = plan_of(search.count_contents(stored["contents"], stored["creators"], stored["content_metrics"], wanted))
    assert "EqualTo(platform,BUILDING)" in plan and "IsNull(project_id)" in plan
    assert "GreaterThanOrEqual(view_count,100)" in plan
    assert "LeftOuter" not in plan
    assert "title" not in plan


def test_count_joins_only_what_filters_read(spark, stored):
    plan = plan_of(
        search.count_contents(
            stored["contents"], stored["creators"], stored["content_metrics"], search.ContentSearch(keyword="low")
        )
    )
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 2


def test_hot_creator_is_split(spark):
    """A creator with a third of all contents does not end up in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = 60_000
        contents = spark.range(0, rows, 1, 8).select(
            "id",
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("influencer_id"),
            F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("project_id"),
        )
        creators = spark.range(rows).select("id", F.col("id").cast("string").alias("name"))
        projects = spark.range(5).select("id", F.col("id").cast("string").alias("name"))
        metrics = spark.range(rows).select(F.col("id").alias("content_id"), F.lit(1).alias("view_count"))
        joined = star(contents, creators, projects, metrics).select("c.id", "i.name", "m.view_count")
        assert len(joined.collect()) == rows
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan or "isSkew=true" in plan or "(skew" in plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_bucketed_tables_join_without_shuffle(spark, stored, tmp_path):
    contents = write_bucketed(stored["contents"], "contents_b", str(tmp_path / "c"), "id", 4)
    metrics = write_bucketed(stored["content_metrics"], "metrics_b", str(tmp_path / "m"), "content_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_metrics(contents.alias("c"), metrics).select("c.id", "m.view_count")
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == stored["contents"].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table contents_b")
        spark.sql("drop table metrics_b")


def test_written_tables_live_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(3))
    assert shared_folder(spark) in df.inputFiles()[0]
    assert df.count() == 3


def test_layouts_are_declared(spark, stored):
    assert list(stored["contents"].columns) == list(TABLES["contents"])


def below(plan, join):
    """The part of a simple plan below the first line that holds ``join``."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if join in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    inside = []
    for line in lines[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-*()0123456789")) <= depth:
            break
        inside.append(line)
    return "\n".join(inside)


def test_star_over_buckets_shuffles_neither_contents_nor_metrics(spark, stored, tmp_path):
    hot = stored["contents"].withColumn("influencer_id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("influencer_id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        contents, metrics = write_star(hot, stored["content_metrics"], str(tmp_path), buckets=4)
        joined = star(contents, stored["creators"], stored["projects"], metrics).select("c.id", "i.name", "m.view_count")
        plan = plan_of(joined, "simple")
        assert "Exchange" not in below(plan, "SortMergeJoin [id#") and "content_id" in below(plan, "SortMergeJoin [id#")
        assert joined.count() == hot.join(stored["creators"], F.col("influencer_id") == stored["creators"]["id"]).count()
        # The hot creator's contents lie in all buckets.
        sizes = [r["n"] for r in contents.where("influencer_id = 1").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_key_filter_lets_all_keys_and_few_others_through(spark):
    keys = cut_lineage(spark.range(0, 3000, 3).select(F.xxhash64("id").alias("hash")))
    test = key_filter(keys, "hash", keys.count())
    rows = spark.range(100_000)
    assert rows.filter("id < 3000 and id % 3 = 0").filter(test(F.xxhash64("id"))).count() == 1000
    assert rows.filter("id >= 3000").filter(test(F.xxhash64("id"))).count() < 5000
    assert rows.filter(key_filter(keys.limit(0), "hash", 0)(F.xxhash64("id"))).count() == 0


def test_stored_rows_that_cannot_match_are_not_shuffled(spark, stored, monkeypatch):
    monkeypatch.setattr(keyfilter, "FROM_KEYS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = stored["creators"].where("id % 50 = 0").withColumn("id", F.col("id") + 10**6)
        seen = stored_with_keys_of(batch, stored["creators"], ["name", "platform"])
        rows = seen.collect()
        assert {r["id"] % 50 for r in rows} == {0} and len(rows) == batch.count()
        plan = plan_of(seen)
        assert "Subquery" in plan and "bitmap" in plan
        asked = search.lookup_contents(
            stored["contents"].where("id % 40 = 0").select(F.col("id").cast("string").alias("key")),
            stored["contents"], stored["creators"], stored["projects"], stored["content_metrics"],
        )
        assert asked.filter("lookup = 'ok'").count() == stored["contents"].where("id % 40 = 0").count()
        assert plan_of(asked).count("bitmap") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latest_contents_behind_many_without_a_creator(spark, stored):
    newest = stored["contents"].orderBy(F.desc("published_at"), F.desc("id")).limit(300).select("id", F.lit(-1).alias("nobody"))
    holes = stored["contents"].join(newest, "id", "left").withColumn("influencer_id", F.coalesce("nobody", "influencer_id")).drop("nobody")
    found = [r["id"] for r in latest_ids(holes, stored["creators"], 5).orderBy(F.desc("published_at"), F.desc("id")).collect()]
    known = holes.join(stored["creators"].select(F.col("id").alias("influencer_id")), "influencer_id", "left_semi")
    assert found == [r["id"] for r in known.orderBy(F.desc("published_at"), F.desc("id")).limit(5).collect()]
    assert latest_ids(holes, stored["creators"].limit(0), 5).count() == 0
    assert latest_ids(holes.limit(3), stored["creators"].unionByName(stored["creators"].limit(1).withColumn("id", F.lit(-1).cast("bigint"))), 5).count() <= 3


def test_overview_scans_contents_and_metrics_once(spark, stored):
    cells = overview_cells(stored["contents"], stored["content_metrics"])
    plan = plan_of(cells)
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 2 and "title" not in plan
    seen = []
    import engagement.plans.dashboard as module

    original = module.cut_lineage
    module.cut_lineage = lambda df: seen.append(plan_of(df)) or original(df)
    try:
        parts = module.dashboard(stored["creators"], stored["projects"], stored["contents"], stored["content_metrics"], AS_OF)
    finally:
        module.cut_lineage = original
    for part in (parts.totals, parts.platform_distribution, parts.sync_distribution):
        assert "view_count:bigint" not in plan_of(part) and "title" not in plan_of(part)
    assert sum("sync_status" in plan and "platform" in plan for plan in seen) == 1


def test_extracts_of_several_ages(spark, tmp_path):
    def write(ddl, *rows):
        spark.createDataFrame(list(rows), ddl).coalesce(1).write.mode("append").parquet(str(tmp_path))

    write("id bigint, name string, platform string", (1, "a", "p"))
    write("id bigint, name string, platform string, status string, remark string", (2, "b", "p", None, "x"), (3, "c", "p", "s", None))
    write("id bigint, name string, platform string, followers int", (4, "d", "p", 7))
    found = read_extracts(spark, str(tmp_path), "creators", ("id", "name", "platform"), {"followers": "int"})
    rows = {r["id"]: (r["status"], r["remark"], r["followers_count"], r["followers"]) for r in found.collect()}
    assert rows == {1: ("正常", "", 0, None), 2: (None, "x", 0, None), 3: ("s", None, 0, None), 4: ("正常", "", 0, 7)}
    write("id bigint, platform string", (5, "p"))
    with pytest.raises(ValueError, match="required"):
        read_extracts(spark, str(tmp_path), "creators", ("id", "name", "platform"))


def test_a_tag_is_not_found_inside_a_longer_one(spark):
    rows = spark.createDataFrame([(1, "科技、音乐"), (2, "科技新闻"), (3, "")], "id bigint, category string")
    tagged = with_tags(rows)
    assert [r["id"] for r in tagged.where(has_tag("tags", " 科技 ")).collect()] == [1]
    assert has_tag("tags", " ") is None


def test_well_compressed_table_is_not_broadcast_by_its_file_size(spark):
    session = configure(spark.newSession())
    assert configure(session).conf.get("spark.sql.autoBroadcastJoinThreshold") == str(BROADCAST)
    # 800,000 rows of 100 bytes and more in a file of some 3 MB.
    wide = session.range(800_000).select(F.col("id").alias("content_id"), F.lit("x" * 80).alias("note"))
    wide = cut_lineage(wide.repartition(1))
    found = session.range(2_000_000).join(wide, F.col("id") == F.col("content_id"), "left")
    assert "BroadcastHashJoin" not in plan_of(found)


def test_threshold_that_is_smaller_or_off_stays(spark):
    for given in ("-1", "262144"):
        session = spark.newSession()
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
        configure(session)
        assert session.conf.get("spark.sql.autoBroadcastJoinThreshold") == given


def test_directory_is_dealt_out_before_it_is_aggregated(spark, folder):
    plan = plan_of(creator_directory(Tables(spark, folder).part_creators()), "simple")
    assert plan.count("Exchange ") == 1
    assert plan.rindex("Aggregate") < plan.index("Exchange ")


def test_records_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    lines = spark.range(100).select(F.col("id").alias("seq"), F.concat(F.lit('{"name": "'), F.col("id"), F.lit('"}')).alias("body"))
    lines.coalesce(1).write.parquet(str(tmp_path / "lines"))
    plan = plan_of(parse_records(spark.read.parquet(str(tmp_path / "lines"))), "simple")
    assert plan.index("Project") < plan.index("Exchange hashpartitioning(seq")

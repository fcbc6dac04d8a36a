"""One runnable query per operator, over the views of a test table folder."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lifecycle import with_project_status
from ..functions.links import with_canonical_url, with_content_id
from ..functions.numbers import interactions, interactions_or_zero
from ..functions.text import matches_keyword
from ..operators import backfill, identity, joins, metrics, pages, quality, rollups
from ..operators.filters import equals, has_tag, in_range, linked_to, where
from ..schemas import CREATORS, PROJECTS, ddl
from ..session import configure, cut_lineage, scratch_path
from ..sources import records, tables
from ..sources.adapters import AS_OF, NOW, PAGE_ID_RULES, Tables
from ..sources.sinks import append_log, metric_table, upsert_metrics, write_parts, write_star
from ..streaming.metric_stream import start_metric_table
from . import report, search
from .dashboard import dashboard, recent_contents
from .sync import run_sync

QUERIES = {}


def registered(query):
    def run(spark, folder):
        return query(Tables(configure(spark), folder))

    QUERIES[query.__name__] = run
    return query


def _as_texts(parts, keys):
    """Rows of several layouts as (part, key, values): the values as text, null as \\N."""
    rows = []
    for name, df in parts.items():
        values = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns if c != "key"])
        rows.append(df.select(F.lit(name).alias("part"), F.col(keys.get(name, "content_id")).alias("key"), values.alias("values")))
    first, *rest = rows
    for df in rest:
        first = first.unionByName(df)
    return first


# Sources and sinks


@registered
def src_1_table_scan(t):
    path = scratch_path(t.spark, "tables")
    parts = {
        "creators": t.creators(), "projects": t.projects(), "contents": t.contents(), "content_metrics": t.metrics(),
        "sync_logs": metrics.sync_log(t.metric_events()),
    }
    write_parts(parts, path)
    keys = {name: "id" for name in ("creators", "projects", "contents")}
    return _as_texts({name: tables.read_table(t.spark, f"{path}/{name}", name) for name in parts}, keys)


@registered
def src_2_json_ingest(t):
    parsed = records.parse_records(t.creator_lines())
    return records.read_fields(parsed, ["name"], ["followers_count"]).select(
        "seq",
        "name",
        records.number_value("followers_count").alias("followers_count"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@registered
def src_3_page_scan(t):
    found = tables.read_pages(t.spark, f"{t.folder}/pages.parquet")
    return found.select("page_id", "url", F.sha2("html", 256).alias("html_sha256"))


@registered
def snk_1_result_write(t):
    contents, creators, projects, content_metrics = t.star()
    parts = dashboard(creators, projects, contents, content_metrics, AS_OF).parts()
    path = scratch_path(t.spark, "dashboard")
    write_parts(parts, path, "json")
    read = {name: t.spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in parts.items()}
    order = {
        "totals": ["influencer_count"],
        "recent_contents": [F.desc("published_at"), F.desc("id")],
        "platform_distribution": [F.desc("content_count"), F.desc("view_count"), "platform"],
        "sync_distribution": [F.desc("content_count"), "sync_status"],
    }
    # A few rows each; the order is checked as part of the key.
    read = {
        name: df.withColumn("key", F.row_number().over(Window.orderBy(*order[name])).cast("bigint"))
        for name, df in read.items()
    }
    return _as_texts(read, dict.fromkeys(read, "key"))


@registered
def snk_2_metric_upsert(t):
    folder = scratch_path(t.spark, "metrics")
    events = t.metric_events()
    for half in (0, 1):
        upsert_metrics(events.filter(F.col("seq") % 2 == half), folder)
    return metric_table(t.spark, folder)


@registered
def snk_3_sync_log_append(t):
    path = scratch_path(t.spark, "log")
    log = metrics.sync_log(t.metric_events())
    for status in ("成功", "失败"):
        append_log(log.filter(F.col("status") == status), path)
    return tables.read_table(t.spark, path, "sync_logs")


# Filters and projections


@registered
def flt_1_keyword(t):
    rows = where(t.creators(), matches_keyword("omer#%01_", "name", "owner"))
    return rows.select("id", "name", "owner")


@registered
def flt_2_platform(t):
    return where(t.creators(), equals(F.col("platform"), "BUILDING")).select("id", "platform")


@registered
def flt_3_range(t):
    rows = joins.with_metrics(t.contents().alias("c"), t.metrics())
    few = in_range(F.col("m.view_count"), None, 60, "views", missing_is_zero=True)
    some = in_range(interactions("m."), "0", "12", "interactions")
    return where(rows, few, some).select(
        "c.id",
        F.coalesce("m.view_count", F.lit(0)).alias("view_count"),
        interactions("m.").alias("interaction_count"),
    )


@registered
def flt_4_project_link(t):
    rows = t.contents()
    unlinked = where(rows, linked_to(F.col("project_id"), "none"))
    linked = where(rows, linked_to(F.col("project_id"), "7"))
    return unlinked.unionByName(linked).select("id", "project_id")


@registered
def flt_5_derived_status(t):
    rows = with_project_status(t.dated_projects(), AS_OF)
    return where(rows, equals(F.col("status"), "已结束")).select("id", "status", "end_date")


@registered
def flt_6_tag(t):
    return where(t.part_creators(), matches_keyword("Economy", "category")).select("id", "category")


@registered
def flt_6_tag_array(t):
    # A keyword finds Brand#1 inside Brand#12 as well, a whole tag does not.
    tagged = cut_lineage(quality.with_tags(t.part_creators()))
    found = where(tagged, has_tag("tags", "Brand#1")).select("id", F.lit("tag").alias("form"))
    return found.unionByName(where(tagged, matches_keyword("Brand#1", "category")).select("id", F.lit("keyword").alias("form")))


@registered
def prj_1_content_detail(t):
    return search.content_details(*t.star())


@registered
def prj_2_interactions(t):
    holes = t.metrics().withColumn("like_count", F.nullif("like_count", F.lit(4)))
    return joins.with_metrics(t.contents().alias("c"), holes).select(
        "c.id",
        interactions("m.").alias("interaction_count"),
        interactions_or_zero("m.").alias("recent_interaction_count"),
    )


@registered
def prj_3_row_defaults(t):
    holes = t.creators().withColumn(
        "followers_count", F.when(F.col("status") == "正常", F.col("followers_count"))
    )
    return search.search_creators(holes, search.CreatorSearch()).select("id", "followers_count")


# Searches


@registered
def search_1_creators(t):
    wanted = search.CreatorSearch(
        keyword="customer#", platform="MACHINERY", category="美食", owner="nation_1",
        followers_min="500", followers_max=9000,
    )
    return search.search_creators(t.creators(), wanted)


@registered
def search_2_projects(t):
    wanted = search.ProjectSearch(as_of=AS_OF, keyword="p1", status="进行中", owner="h")
    return search.search_projects(t.dated_projects(), wanted)


@registered
def search_3_contents(t):
    wanted = search.ContentSearch(
        keyword="-urgent", platform="BUILDING", project_id="none",
        views_min=10, views_max=200, interactions_min=5, interactions_max=60,
    )
    return search.search_contents(*t.star(), wanted)


@registered
def search_4_lookup(t):
    # Every line item asks for its order; some keys are unknown or no number.
    key = F.col("l_orderkey")
    keys = t.raw("lineitem").select(
        F.when(key % 11 == 0, F.concat(key.cast("string"), F.lit("x")))
        .when(key % 7 == 0, (-key - 1).cast("string"))
        .otherwise(key.cast("string"))
        .alias("key")
    )
    found = search.lookup_contents(keys, *t.star())
    return found.select("key", "lookup", "id", "title", "influencer_name", "interaction_count")


@registered
def search_4_lookup_creators(t):
    keys = t.raw("orders").select((F.col("o_custkey") * 2).cast("string").alias("key"))
    return search.lookup_creators(keys, t.creators()).select("key", "lookup", "id", "name", "followers_count")


@registered
def search_4_lookup_projects(t):
    key = F.col("l_orderkey")
    keys = t.raw("lineitem").select(F.concat(F.lit(" "), (key * 2).cast("string")).alias("key"))
    found = search.lookup_projects(keys, t.dated_projects(), AS_OF)
    return found.select("key", "lookup", "id", "status", "status_error")


# Joins


@registered
def jn_1_star(t):
    return joins.star(*t.star()).select(
        "c.id",
        F.col("i.name").alias("influencer_name"),
        F.col("p.name").alias("project_name"),
        "m.view_count",
    )


@registered
def jn_1_bucketed_star(t):
    contents, creators, projects, content_metrics = t.star()
    contents, content_metrics = write_star(contents, content_metrics, scratch_path(t.spark, "star"))
    return joins.star(contents, creators, projects, content_metrics).select(
        "c.id",
        F.col("i.name").alias("influencer_name"),
        F.col("p.name").alias("project_name"),
        "m.view_count",
    )


@registered
def jn_2_contents_metrics(t):
    rows = joins.with_metrics(t.contents().alias("c"), t.metrics())
    return rows.select("c.id", "m.view_count", "m.sync_status")


@registered
def jn_3_missing_references(t):
    shifted = t.contents().withColumns(
        {"influencer_id": F.col("influencer_id") + 40, "project_id": F.col("project_id") * 2}
    )
    found = joins.missing_references(shifted, t.creators(), t.projects())
    return found.select("id", "influencer_id", "project_id", "reason")


@registered
def jn_4_stored_duplicates(t):
    rows = t.part_creators()
    even, odd = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    inserts = joins.stored_duplicates(odd, even, ["name", "platform"])
    updates = joins.stored_duplicates(rows, rows, ["name", "platform"], exclude_self=True)
    return inserts.select("id", F.lit("insert").alias("entry")).union(
        updates.select("id", F.lit("update").alias("entry"))
    )


@registered
def jn_4_stored_projects(t):
    rows = t.dated_projects()
    moved = rows.withColumn("project_code", F.when(F.col("id") % 2 == 0, F.col("project_code")).otherwise("P7"))
    found = joins.stored_duplicates(moved, rows, ["project_code"], exclude_self=True)
    return found.select("id", "project_code")


@registered
def jn_4_stored_contents(t):
    rows = t.entangled_contents()
    found = identity.stored_identity_conflicts(rows, rows, "id", target="id")
    return rows.join(found, "id").select("id", "content_url", "platform", "platform_content_id")


@registered
def jn_5_resolve_creators(t):
    found = joins.resolve_creators(t.creator_references(), t.part_creators())
    return found.select("ref_id", "platform", "resolved_id")


# Aggregations and sorts


@registered
def agg_1_totals(t):
    return rollups.platform_totals(t.creators(), t.dated_projects(), t.contents(), t.metrics(), AS_OF)


@registered
def agg_1_one_pass(t):
    # Totals and both distributions from one pass over contents and metrics.
    cells = cut_lineage(rollups.overview_cells(t.contents(), t.metrics()))
    totals = rollups.totals_of_cells(cells, t.creators(), t.dated_projects(), AS_OF)
    parts = [
        totals.select(
            F.lit("totals").alias("part"), F.lit("").alias("name"), "content_count",
            F.col("total_views").alias("view_count"), "total_interactions", "active_project_count",
        ),
        rollups.platforms_of_cells(cells).select(F.lit("platform").alias("part"), F.col("platform").alias("name"), "content_count", "view_count"),
        rollups.statuses_of_cells(cells).select(F.lit("status").alias("part"), F.col("sync_status").alias("name"), "content_count"),
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@registered
def agg_2_platform_rollup(t):
    return rollups.platform_rollup(t.contents(), t.metrics())


@registered
def agg_3_sync_rollup(t):
    return rollups.sync_rollup(t.metrics())


@registered
def agg_4_running_projects(t):
    return rollups.running_projects(t.dated_projects(), AS_OF)


@registered
def agg_5_result_count(t):
    contents, creators, _, content_metrics = t.star()
    by_creator = search.CreatorSearch(keyword="customer#0000", followers_min=1000)
    by_project = search.ProjectSearch(as_of=AS_OF, status="已归档")
    by_content = search.ContentSearch(keyword="low", views_min=100, interactions_max=70)
    counts = [
        ("creators", rollups.row_count(by_creator.matching(t.creators()))),
        ("projects", rollups.row_count(by_project.matching(t.dated_projects()))),
        ("contents", search.count_contents(contents, creators, content_metrics, by_content)),
    ]
    first, *rest = [df.select(F.lit(name).alias("list"), "row_count") for name, df in counts]
    for df in rest:
        first = first.unionByName(df)
    return first


@registered
def srt_1_recent_contents(t):
    return rollups.with_position(recent_contents(*t.star()))


@registered
def srt_2_newest_first(t):
    rows = search.search_contents(*t.star(), search.ContentSearch()).select("id", "created_at", "title")
    return rollups.with_position(rows)


@registered
def srt_3_ranked_rollups(t):
    contents, content_metrics = t.contents(), t.metrics()
    by_platform = rollups.ranked(
        rollups.platform_rollup(contents, content_metrics), "content_count", "view_count"
    )
    by_status = rollups.ranked(rollups.sync_rollup(content_metrics), "content_count")
    by_platform = rollups.with_position(by_platform).select(
        F.lit("platform").alias("rollup"), F.col("platform").alias("group_key"), "content_count", "view_count", "position"
    )
    by_status = rollups.with_position(by_status).select(
        F.lit("sync_status"), "sync_status", "content_count", F.lit(None).cast("bigint"), "position"
    )
    return by_platform.union(by_status)


# Jobs


@registered
def job_1_canonical_url(t):
    return with_canonical_url(t.link_texts(), "raw_url", error="url_error")


@registered
def job_2_content_id(t):
    links = with_content_id(with_canonical_url(t.platform_links()))
    own = t.raw("pages").select(F.col("page_id").alias("id"), "url", F.lit("").alias("platform"))
    own = with_content_id(with_canonical_url(own, "url"), PAGE_ID_RULES)
    columns = ["id", "canonical_url", "platform_content_id"]
    return links.select(*columns).union(own.select(*columns))


@registered
def job_3_identity_dedup(t):
    return identity.deduplicate(t.page_contents()).select("id", "content_url", "accepted")


@registered
def job_3_identity_chains(t):
    return identity.deduplicate(t.entangled_contents()).select("id", "content_url", "accepted")


@registered
def job_4_uniqueness_audit(t):
    found = [
        identity.uniqueness_violations(t.part_creators(), "creators"),
        identity.uniqueness_violations(t.dated_projects(), "projects"),
        identity.uniqueness_violations(t.entangled_contents(), "contents"),
        identity.uniqueness_violations(
            t.raw("lineitem").select(F.col("l_orderkey").alias("content_id")), "content_metrics", "content_id"
        ),
    ]
    first, *rest = found
    for df in rest:
        first = first.unionByName(df)
    return first


@registered
def job_5_validate_creators(t):
    renamed = F.when(F.col("id") % 10 == 0, F.col("name")).otherwise(F.concat(F.lit("stored "), F.col("name")))
    stored = t.creators().withColumns({"platform": F.lit("抖音"), "name": renamed})
    checked = quality.validate_creators(records.parse_records(t.creator_lines()), stored)
    return checked.select("seq", "name", "category", "followers_count", "phone", "email", "reason")


@registered
def job_5_validate_projects(t):
    stored = t.projects()
    parsed = records.parse_records(t.project_lines())
    return quality.validate_projects(parsed, stored, AS_OF).select("seq", "project_code", "status", "reason")


@registered
def job_5_validate_contents(t):
    stored = t.contents()
    parsed = records.parse_records(t.content_lines())
    creators = t.creators().withColumn("platform", F.lit("抖音"))
    checked = quality.validate_contents(parsed, creators, t.projects(), stored)
    return checked.select("seq", "influencer_id", "canonical_url", "platform_content_id", "view_count", "share_count", "reason")


@registered
def job_5_update_creators(t):
    key = F.col("seq")
    target = F.when(key % 5 == 0, key + 1).when(key % 7 == 0, -key - 1).otherwise(key)
    parsed = records.parse_records(t.creator_lines()).withColumn("id", target)
    stored = t.creators().withColumn("platform", F.lit("抖音"))
    return quality.validate_creator_updates(parsed, stored).select("seq", "id", "name", "reason")


@registered
def job_5_update_projects(t):
    key = F.col("seq")
    parsed = records.parse_records(t.project_lines()).withColumn("id", F.when(key % 3 == 0, -key - 1).otherwise(key))
    checked = quality.validate_project_updates(parsed, t.dated_projects(), AS_OF)
    return checked.select("seq", "id", "project_code", "reason")


@registered
def job_5_update_contents(t):
    parsed = records.parse_records(t.content_lines())
    parsed = parsed.withColumn("id", F.when(F.col("seq") % 13 == 0, -1).otherwise(F.col("seq")))
    creators = t.creators().withColumn("platform", F.lit("抖音"))
    number = F.col("id").cast("string")
    url = F.concat(F.lit("https://www.douyin.com/video/"), number)
    stored = t.contents().withColumns(
        {"platform": F.lit("抖音"), "content_url": url, "canonical_url": url, "platform_content_id": number}
    )
    checked = quality.validate_content_updates(parsed, creators, t.projects(), stored)
    return checked.select("seq", "id", "canonical_url", "reason")


@registered
def job_6_contacts(t):
    return quality.normalize_contacts(t.contacts()).drop("platform")


@registered
def job_6_contact_counts(t):
    return quality.contact_counts(quality.normalize_contacts(t.contacts()))


@registered
def job_7_tags(t):
    return quality.normalize_tags(t.tagged())


@registered
def job_8_project_status(t):
    return with_project_status(t.dated_projects(), AS_OF).select("id", "status", "status_error")


@registered
def job_9_page_metrics(t):
    found = pages.page_metrics(t.metric_pages())
    return found.select("page_id", "like_count", "comment_count", "collect_count", "outcome")


@registered
def job_9_page_labels(t):
    # The test pages carry "ad N" comments, the events a quoted field "k".
    ads = pages.page_metrics(
        t.raw("pages"), fields={"like_count": ("adCount",)}, labels={"like_count": ("ad",)}, supported=F.lit(True)
    )
    fields = pages.page_metrics(
        t.raw("events").withColumnRenamed("props", "html"),
        fields={"like_count": ("k",)}, labels={}, supported=F.lit(True),
    )
    return ads.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), "like_count", "outcome").union(
        fields.select(F.lit("events"), "event_id", "like_count", "outcome")
    )


@registered
def job_9_page_sync(t):
    # Every page is the link of one content; contents of odd ids link to no page.
    key = F.col("page_id")
    contents = t.raw("pages").select(
        key.alias("id"),
        (key % 10).alias("influencer_id"),
        F.when(key % 9 == 8, "抖音").otherwise("小红书").alias("platform"),
        F.concat(F.lit("p"), F.when(key % 2 == 0, key).otherwise(-key).cast("string")).alias("content_url"),
    )
    # Every fifth link was saved once more, by a later page; contents of creator 7 have none.
    again = (key % 5 == 3) & (key % 9 != 8)
    link = F.concat(F.lit("p"), F.when(again, key - 1).otherwise(key).cast("string"))
    creators = t.spark.range(7).union(t.spark.range(8, 10))
    pages_by_id = t.metric_pages().withColumn("url", link)
    folder, log_path = scratch_path(t.spark, "metrics"), scratch_path(t.spark, "log")
    upsert_metrics(t.metric_events(), folder)
    run_sync(contents, creators, pages_by_id, folder, log_path, 10**15, NOW)
    log = tables.read_table(t.spark, log_path, "sync_logs").select(
        F.col("content_id").alias("logged_id"), F.col("status").alias("log_status"), "raw_summary"
    )
    return metric_table(t.spark, folder).join(log, F.col("content_id") == F.col("logged_id"), "left").select(
        "content_id", "view_count", "like_count", "data_source", "sync_status", "last_sync_at", "failed_reason",
        "log_status", "raw_summary",
    )


@registered
def job_10_metric_state(t):
    return metrics.metric_rows(metrics.fold_events(t.metric_events()))


@registered
def job_11_migrate_creators(t):
    return backfill.migrate_creators(t.old_creators(), NOW).select(*CREATORS)


@registered
def job_11_mixed_extracts(t):
    # Extracts of three ages in one folder; the oldest has the old name of a counter only.
    path, age = scratch_path(t.spark, "extracts"), F.floor(F.col("id") / 7) % 3
    extracts = t.old_creators()
    for n, gone in enumerate((("followers_count", "category", "updated_at"), ("updated_at",), ("followers",))):
        extracts.filter(age == n).drop(*gone).write.mode("append").parquet(path)
    read = backfill.read_extracts(t.spark, path, "creators", ("id", "name", "platform"), {"followers": "int"})
    return backfill.migrate_creators(read, NOW).select(*CREATORS)


@registered
def job_11_migrate_projects(t):
    old = t.dated_projects().drop("project_code", "description")
    old = old.withColumn("status", F.when(F.col("status") == "已归档", "归档").otherwise(F.col("status")))
    return backfill.migrate_projects(old).select(*PROJECTS)


@registered
def job_11_migrate_contents(t):
    moved = backfill.migrate_contents(t.old_contents())
    return moved.select("id", "content_url", "canonical_url", "platform_content_id", "status", "remark")


@registered
def job_11_migrate_metrics(t):
    old = t.metrics().drop("data_source", "last_sync_at", "next_sync_at", "failed_reason")
    return backfill.migrate_metrics(old)


@registered
def job_12_creator_report(t):
    return report.creator_report(t.creators())


@registered
def job_12_project_report(t):
    return report.project_report(with_project_status(t.dated_projects(), AS_OF))


@registered
def job_12_content_report(t):
    return report.content_report(search.content_details(*t.star()))


# Streaming


@registered
def str_1_metric_stream(t):
    given, seq = t.metric_events(), F.col("seq")
    source, folder, log, checkpoint = (scratch_path(t.spark, name) for name in ("events", "metrics", "log", "checkpoint"))
    # Later events come first; after a restart come late ones, and a third of all once more.
    runs = [seq % 2 == 1, (seq % 2 == 0) | (seq % 3 == 0)]
    for arrived in runs:
        given.filter(arrived).write.mode("append").parquet(source)
        arriving = tables.stream_table(t.spark, source, ddl(metrics.EVENTS))
        for query in start_metric_table(arriving, folder, log, checkpoint):
            query.awaitTermination()
    return metric_table(t.spark, folder)

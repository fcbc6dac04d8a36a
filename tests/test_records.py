"""Records: parsing, rule order, accepted + refused = input."""

import json

import pytest
from pyspark.sql import functions as F

from engagement.operators import quality
from engagement.operators.backfill import migrate_metrics, with_missing_columns
from engagement.operators.metrics import entry_events, fold_events, metric_rows
from engagement.schemas import CONTENT_METRICS, CREATORS, ddl
from engagement.sources.records import number_value, parse_records, read_fields, read_lines

GOOD = {"name": "A", "platform": "B站", "category": "美食"}


def parsed(spark, *bodies):
    texts = [b if isinstance(b, str) else json.dumps(b, ensure_ascii=False) for b in bodies]
    return parse_records(spark.createDataFrame(list(enumerate(texts)), "seq bigint, body string"))


def reasons(df):
    return [row["reason"] for row in df.orderBy("seq").collect()]


def test_parse_reasons(spark):
    size = 100_000
    bodies = [
        "{}", "", "x" * (size + 1), "{" + " " * (size - 2) + "}", "美" * 34_000, '{"a":', "[1]", "5", "null",
        '{"a":1} x', '{"a":1},{"b":2}', "{'a':1}", ' {"a":1, "a":2} ',
    ]
    expected = [
        None, "size", "size", None, "size", "bad_json", "not_an_object", "not_an_object", "not_an_object",
        "bad_json", "bad_json", "bad_json", None,
    ]
    assert reasons(parsed(spark, *bodies)) == expected


def test_field_types(spark):
    bodies = [
        {"t": " x ", "n": 3.7}, {"t": 0, "n": "3.7"}, {"t": "0", "n": "12"}, {"t": False, "n": True},
        {"t": True, "n": None}, {"t": 5, "n": ""}, {"t": None, "n": -1}, {"n": []}, {"t": [], "n": 1e3},
        {"t": "false", "n": "1_0"}, {"t": 0.0, "n": 12345678901},
    ]
    found = read_fields(parsed(spark, *bodies), ["t"], ["n"]).orderBy("seq").select("t", number_value("n").alias("n")).collect()
    assert [(r["t"], r["n"]) for r in found] == [
        ("x", 3), ("", None), ("0", 12), ("", 1), ("True", None), ("5", None), ("", -1), ("", None),
        ("", 1000), ("false", 10), ("", 12345678901),
    ]


def test_creator_rule_order(spark):
    bodies = [
        GOOD,
        {"category": "钓鱼"},
        {"category": "美食"},
        {"name": "B"},
        {"name": "B", "platform": "X", "status": "?"},
        {**GOOD, "name": "B", "status": "?", "followers_count": "x"},
        {**GOOD, "name": "B", "followers_count": "x", "profile_url": "y"},
        {**GOOD, "name": "B", "followers_count": -1, "profile_url": "y"},
        {**GOOD, "name": "B", "profile_url": "y", "phone": "1"},
        {**GOOD, "name": "B", "phone": "1", "email": "e"},
        {**GOOD, "name": "B", "email": "e"},
        GOOD,
        {**GOOD, "name": "stored"},
        {**GOOD, "platform": "抖音"},
        {**GOOD, "name": "C", "followers": 5},
        {**GOOD, "name": "D", "followers_count": None, "followers": 5},
    ]
    stored = spark.createDataFrame([("stored", "B站")], "name string, platform string")
    checked = quality.validate_creators(parsed(spark, *bodies), stored)
    assert reasons(checked) == [
        None, "category_unknown", "name_empty", "platform_empty", "platform_unknown", "status_unknown",
        "followers_not_a_number", "followers_negative", "profile_url_scheme", "phone_invalid", "email_invalid",
        "duplicate_creator", "duplicate_creator", None, None, None,
    ]
    followers = {r["name"]: r["followers_count"] for r in checked.collect()}
    assert followers["C"] == 5 and followers["D"] == 0
    accepted, refused = quality.split_by_reason(checked)
    assert accepted.count() + refused.count() == len(bodies)
    counts = {r["reason"]: r["record_count"] for r in quality.reason_counts(checked).collect()}
    assert counts["accepted"] == 4 and counts["duplicate_creator"] == 2


def test_duplicate_of_a_refused_record_is_accepted(spark):
    bodies = [{**GOOD, "email": "bad"}, GOOD, GOOD]
    checked = quality.validate_creators(parsed(spark, *bodies), spark.createDataFrame([], ddl(CREATORS)))
    assert reasons(checked) == ["email_invalid", None, "duplicate_creator"]


def test_project_rules(spark):
    bodies = [
        {"name": "A", "project_code": "P1", "status": "未开始"},
        {"name": " ", "status": "?"},
        {"name": "A", "status": "?"},
        {"name": "A", "start_date": "x", "end_date": "y"},
        {"name": "A", "end_date": "y"},
        {"name": "A", "start_date": "2024-02-01", "end_date": "2024-01-01"},
        {"name": "A", "status": "归档", "start_date": "x"},
        {"name": "A", "project_code": "P1"},
        {"name": "A", "project_code": "P9"},
        {"name": "A", "project_code": ""},
        {"name": "A", "project_code": ""},
    ]
    stored = spark.createDataFrame([("P9",)], "project_code string")
    checked = quality.validate_projects(parsed(spark, *bodies), stored, "2024-06-01")
    assert reasons(checked) == [
        None, "name_empty", "status_unknown", "start_date_invalid", "end_date_invalid", "end_before_start",
        None, "duplicate_project_code", "duplicate_project_code", None, None,
    ]
    status = {r["seq"]: r["status"] for r in checked.collect()}
    assert status[0] == "进行中" and status[6] == "已归档"


def test_content_rules(spark):
    good = {"title": "T", "influencer_id": 1, "content_url": "https://x.y/1", "published_at": "d"}
    bodies = [
        good,
        {**good, "influencer_id": "x", "project_id": "y"},
        {**good, "influencer_id": 0},
        {**good, "project_id": -1, "title": ""},
        {**good, "title": " "},
        {**good, "influencer_id": None, "content_url": ""},
        {**good, "content_url": "", "published_at": ""},
        {**good, "published_at": "", "status": "?"},
        {**good, "status": "?", "content_type": "?"},
        {**good, "content_type": "?", "influencer_id": 9},
        {**good, "influencer_id": 9, "project_id": 9},
        {**good, "project_id": 9, "view_count": "x"},
        {**good, "view_count": "x", "like_count": -1},
        {**good, "like_count": -1},
        {**good, "content_url": "https://M.x.y/1/?q"},
        {**good, "content_url": "https://x.y/2", "platform": "微博", "project_id": "2", "view_count": 3.9},
        {**good, "content_url": "https://old.one/"},
    ]
    creators = spark.createDataFrame([(1, "B站")], "id bigint, platform string")
    projects = spark.createDataFrame([(2,)], "id bigint")
    stored = spark.createDataFrame(
        [(7, "B站", "https://old.one", "https://old.one", "")],
        "id bigint, platform string, content_url string, canonical_url string, platform_content_id string",
    )
    checked = quality.validate_contents(parsed(spark, *bodies), creators, projects, stored)
    assert reasons(checked) == [
        None, "creator_id_invalid", "creator_id_invalid", "project_id_invalid", "title_empty",
        "creator_missing", "content_url_empty", "published_at_empty", "status_unknown",
        "content_type_unknown", "creator_not_found", "project_not_found", "view_count_not_a_number",
        "like_count_negative", "duplicate_content", None, "duplicate_content",
    ]
    accepted, _ = quality.split_by_reason(checked)
    state = metric_rows(fold_events(entry_events(accepted, "create", "now", "seq")))
    assert {r["content_id"]: r["view_count"] for r in state.collect()} == {0: 0, 15: 3}
    kept = checked.filter("seq = 15").first()
    assert (kept["platform"], kept["project_id"], kept["view_count"]) == ("B站", 2, 3)
    assert (kept["content_type"], kept["data_source"], kept["sync_status"]) == ("视频", "手动", "待同步")


def test_updates_against_other_rows(spark):
    stored = spark.createDataFrame([(1, "A", "B站"), (2, "B", "B站")], "id bigint, name string, platform string")
    bodies = [GOOD, GOOD, {**GOOD, "name": "C"}, {**GOOD, "email": "x"}, {**GOOD, "name": "Z"}]
    records = parsed(spark, *bodies).withColumn("id", F.element_at(F.array(*map(F.lit, (1, 2, 2, 9, 9))), (F.col("seq") + 1).cast("int")))
    checked = quality.validate_creator_updates(records, stored)
    assert reasons(checked) == [None, "duplicate_creator", None, "email_invalid", "not_found"]

    codes = spark.createDataFrame([(1, "P"), (2, "")], "id bigint, project_code string")
    bodies = [{"name": "A", "project_code": "P"}, {"name": "A", "project_code": "P"}, {"name": "A"}]
    records = parsed(spark, *bodies).withColumn("id", F.element_at(F.array(*map(F.lit, (1, 2, 2))), (F.col("seq") + 1).cast("int")))
    checked = quality.validate_project_updates(records, codes, "2024-06-01")
    assert reasons(checked) == [None, "duplicate_project_code", None]


def test_lines_from_files(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"name": "A"}\n\n{"name": "B"}\n', encoding="utf8")
    assert sorted(str(r["reason"]) for r in parse_records(read_lines(spark, str(path))).collect()) == ["None", "None", "size"]


def test_missing_columns(spark):
    old = spark.createDataFrame([(1, 5)], "content_id bigint, view_count bigint")
    row = migrate_metrics(old).first()
    assert row.asDict() == {
        **{n: ("" if kind == "string" else 0) for n, kind in CONTENT_METRICS.items()}, "content_id": 1, "view_count": 5,
        "data_source": "手动", "sync_status": "待同步",
    }
    with pytest.raises(ValueError):
        with_missing_columns(old.select(F.col("view_count")), "content_metrics", ("content_id",))


def test_what_follows_a_record_is_an_error(spark):
    bodies = ['{"a":1}]', '{"a":1}] x', '{"a":1}],[{"b":2}', '{"a":1} ] trailing junk {', '{"a":[1]}', ' {"a":"]"} ', "[1]"]
    lines = spark.createDataFrame(list(enumerate(bodies)), "seq bigint, body string")
    found = {r["seq"]: r["reason"] for r in parse_records(lines).collect()}
    assert found == {0: "bad_json", 1: "bad_json", 2: "bad_json", 3: "bad_json", 4: None, 5: None, 6: "not_an_object"}


def test_lines_are_numbered_by_file_and_position(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("first\n")
    (tmp_path / "b.jsonl").write_text("".join(f"b{i}\n" for i in range(2000)))
    (tmp_path / "c.jsonl").write_text("c0\nc1")
    expected = ["first", *[f"b{i}" for i in range(2000)], "c0", "c1"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_lines(spark, str(tmp_path)).collect()
            assert [r["body"] for r in sorted(rows)] == expected
            assert sorted(r["seq"] for r in rows) == list(range(len(expected)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

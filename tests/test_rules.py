"""Hand-made cases for the exact rules of the expressions."""

import pytest
from pyspark.sql import functions as F

from engagement.functions import contacts
from engagement.functions.lifecycle import with_project_status
from engagement.functions.links import ContentIdRule, with_canonical_url, with_content_id
from engagement.functions.numbers import displayed_count, interactions, interactions_or_zero
from engagement.functions.tags import clean_tags
from engagement.functions.text import WHITESPACE, matches_keyword, strip, whole_number
from engagement.operators.filters import bound, in_range, linked_to
from engagement.operators.pages import page_metrics
from engagement.plans import report
from engagement.sources.adapters import Tables


def test_whitespace_is_all_of_unicode():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip(one):
    assert one(strip(F.col("t")), t="　\x1c a b\xa0\n") == "a b"
    assert one(strip(F.col("t")), t=None) == ""


@pytest.mark.parametrize(
    "keyword, text, found",
    [
        ("abc", "xABCx", True),
        ("É", "é", False),
        ("é", "xéx", True),
        ("a_c", "abc", True),
        ("a%c", "a12c", True),
        ("a\\c", "a\\c", True),
        ("a\\_", "a\\x", True),
        ("达人", "某达人A", True),
        ("abc", "ab", False),
    ],
)
def test_keyword(one, keyword, text, found):
    assert one(matches_keyword(keyword, "t"), t=text) is found


def test_blank_keyword_is_no_filter():
    assert matches_keyword("  ", "t") is None
    assert matches_keyword(None, "t") is None


@pytest.mark.parametrize(
    "text, value",
    [(" 12 ", 12), ("+5", 5), ("-3", -3), ("1_000", 1000), ("3.7", None), ("", None),
     ("1__0", None), ("x", None), ("　7", 7), ("99999999999999999999", None)],
)
def test_whole_number(one, text, value):
    assert one(whole_number(F.col("t")), t=text) == value


def test_bounds():
    assert bound("", "n") is None and bound(" 7 ", "n") == 7 and bound(0, "n") == 0
    for bad in ("x", "3.5", "-1", -1):
        with pytest.raises(ValueError):
            bound(bad, "n")
    with pytest.raises(ValueError):
        in_range(None, 5, 4, "n")


def test_project_link_choice(spark):
    with pytest.raises(ValueError):
        linked_to(F.col("p"), "some")
    assert linked_to(None, "") is None


@pytest.mark.parametrize("low, high, kept", [(None, 5, {0, 3, None}), (0, None, {0, 3, 9, None}), (1, 9, {3, 9})])
def test_range_counts_missing_as_zero(spark, low, high, kept):
    rows = spark.createDataFrame([(0,), (3,), (9,), (None,)], "n bigint")
    found = rows.filter(in_range(F.col("n"), low, high, "n", missing_is_zero=True)).collect()
    assert {row["n"] for row in found} == kept


CANONICAL = [
    ("HTTPS://M.X.com/a/;p?q#f", "https://x.com/a"),
    ("see https://m.x.com/A/?t=1。", "https://x.com/A"),
    ("x.com/a/", "x.com/a"),
    ("/", ""),
    ("", ""),
    (None, ""),
    ("https://www.x.com:8080/A/b//", "https://www.x.com:8080/A/b"),
    ("http://u@m.x.com/p;v=1/q;w=2?x", "http://u@m.x.com/p;v=1/q"),
    ("weixin://M.Host/a;b/?q", "weixin://host/a;b"),
    ("weixin://host/a;b", "weixin://host/a;b"),
    ("（http://a.b/c）", "（http://a.b/c）"),
    ("，http://a.b/c", "，http://a.b/c"),
    ("text http://a.b/c), more https://d.e", "http://a.b/c"),
    ("http://a.b/x|y z", "http://a.b/x|y"),
    ("mailto:a@b/", "mailto:a@b"),
    ("//host/p/", "//host/p"),
    ("http://m.m.x.com", "http://m.x.com"),
    ("http://a.b/c?u=http://d.e/", "http://a.b/c"),
]


def test_canonical_url(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in CANONICAL)), "n int, t string")
    found = with_canonical_url(rows, "t").orderBy("n").collect()
    assert [row["canonical_url"] for row in found] == [c for _, c in CANONICAL]


def test_canonical_url_of_a_page_link_is_stable(spark, folder):
    once = with_canonical_url(Tables(spark, folder).raw("pages"), "url", "once")
    twice = with_canonical_url(once, "once", "twice")
    assert twice.filter("once <> twice or once = ''").count() == 0


CONTENT_IDS = [
    ("小红书", "https://www.xiaohongshu.com/explore/abc?x=1", "abc"),
    ("小红书", "https://www.xiaohongshu.com/discovery/item/abc", "item"),
    ("小红书", "https://x.y/item/abc", "abc"),
    ("小红书", "https://x.y/a/explore", ""),
    ("其他", "https://www.XiaoHongShu.com/explore/abc", "abc"),
    ("B站", "https://www.bilibili.com/BV1x", "BV1x"),
    ("B站", "https://m.bilibili.com/video/av7/", "av7"),
    ("B站", "https://b23.tv/x", ""),
    ("抖音", "https://www.douyin.com/user/note/9", "9"),
    ("微博", "https://weibo.com/u/9", "9"),
    ("微博", "https://weibo.com/9", ""),
    ("快手", "https://kuaishou.com/f/9", ""),
    ("小红书", "x.com/explore/abc?d=1", "abc"),
    ("微博", "/", ""),
]


def test_content_id(spark):
    rows = spark.createDataFrame(
        [(n, p, u) for n, (p, u, _) in enumerate(CONTENT_IDS)], "n int, platform string, content_url string"
    )
    found = with_content_id(with_canonical_url(rows)).orderBy("n").collect()
    assert [row["platform_content_id"] for row in found] == [i for _, _, i in CONTENT_IDS]


def test_content_id_rules_are_data(spark):
    rows = spark.createDataFrame([("小红书", "https://a.b/discovery/item/abc")], "platform string, content_url string")
    rules = (ContentIdRule("小红书", "xiaohongshu.com", markers=("item", "discovery")),)
    found = with_content_id(with_canonical_url(rows), rules).first()
    assert found["platform_content_id"] == "abc"


@pytest.mark.parametrize(
    "text, value, reason",
    [
        ("+86 138-0013-8000", "13800138000", None),
        ("008613800138000", "13800138000", None),
        ("12800138000", None, "phone_invalid"),
        ("+86008613800138000", None, "phone_invalid"),
        (" ", "", None),
        (None, "", None),
    ],
)
def test_phone(one, text, value, reason):
    assert tuple(one(contacts.phone(F.col("t")), t=text)) == (value, reason)


@pytest.mark.parametrize(
    "text, value, reason",
    [(" A@B.CO ", "a@b.co", None), ("a@b", None, "email_invalid"), ("a b@c.d", None, "email_invalid"),
     ("a@@b.c", None, "email_invalid"), ("", "", None), ("a@b.c.d", "a@b.c.d", None)],
)
def test_email(one, text, value, reason):
    assert tuple(one(contacts.email(F.col("t")), t=text)) == (value, reason)


@pytest.mark.parametrize(
    "url, platform, reason",
    [
        ("https://space.bilibili.com/1", "B站", None),
        ("HTTPS://B23.TV/1", "B站", None),
        ("https://b23.tv:80/1", "B站", "profile_url_domain"),
        ("https://evilbilibili.com/1", "B站", "profile_url_domain"),
        ("https://a.weibo.cn", "微博", None),
        ("https://any.where/1", "其他", None),
        ("https://any.where/1", "别的", None),
        ("ftp://bilibili.com", "其他", "profile_url_scheme"),
        ("https:///x", "其他", "profile_url_scheme"),
        ("https://b23.tv/a b", "B站", "profile_url_whitespace"),
        ("  ", "B站", None),
    ],
)
def test_profile_url(one, url, platform, reason):
    found = one(contacts.profile_url(F.col("u"), F.col("p")), u=url, p=platform)
    assert found["reason"] == reason


@pytest.mark.parametrize(
    "text, value, unknown",
    [("美食、 旅游,美食，", "美食、旅游", None), ("美食、钓鱼、x", None, "钓鱼"), ("", "", None),
     (None, "", None), ("、,，", "", None)],
)
def test_tags(one, text, value, unknown):
    assert tuple(one(clean_tags(F.col("t")), t=text)) == (value, unknown)


@pytest.mark.parametrize(
    "status, start, end, expected, error",
    [
        ("归档", "x", "y", "已归档", None),
        ("已归档", "2024-02-01", "2024-01-01", "已归档", None),
        ("自动判断", "", "", "进行中", None),
        (None, None, None, "进行中", None),
        ("进行中", "2024-06-02", "", "未开始", None),
        ("进行中", "2024-06-01", "2024-06-01", "进行中", None),
        ("未开始", "2024-01-01", "2024-05-31", "已结束", None),
        ("进行中", "20240101", "", "进行中", None),
        ("进行中", "2024-6-1", "", None, "start_date_invalid"),
        ("进行中", "2024-02-30", "", None, "start_date_invalid"),
        ("进行中", "2024-01-01T", "", None, "start_date_invalid"),
        ("进行中", "", "2026-6-1T", None, "end_date_invalid"),
        ("进行中", "2024-02-01", "2024-01-01", None, "end_before_start"),
    ],
)
def test_lifecycle(spark, status, start, end, expected, error):
    rows = spark.createDataFrame([(status, start, end)], "status string, start_date string, end_date string")
    found = with_project_status(rows, "2024-06-01").first()
    assert (found["status"], found["status_error"]) == (expected, error)


@pytest.mark.parametrize(
    "text, value",
    [("1.2万", 12000), ("1.13w", 11299), ("3k+", 3000), ("1,234", 1234), (",", None), ("", None),
     ("约2千", 2000), ("w7", 70000), ("12.9", 12), ("万千5", 50000), ("9" * 25, None)],
)
def test_displayed_count(one, text, value):
    assert one(displayed_count(F.col("t")), t=text) == value


PAGES = [
    ('{"likedCount":"1.2万","commentCount": 5}', (12000, 5, None, "ok")),
    ('{"LIKEDCOUNT" :\n "7"}', (7, None, None, "ok")),
    ("{'likes':'3k','favorites': 9.7}", (3000, None, 9, "ok")),
    ('{"likedCount":"-","likeCount":8}', (8, None, None, "ok")),
    ('{"likedCount":"-", "likedCount":"5"} 点赞 6', (6, None, None, "ok")),
    ("点 赞 ： 1.5万 12 评论 收藏", (15000, 12, None, "ok")),
    ("赞 , 点赞", (None, None, None, "no_metrics")),
    ("小红书 需要验证", (None, None, None, "challenge")),
    ("nothing", (None, None, None, "no_metrics")),
    ('{"likes": 0}', (0, None, None, "ok")),
]


def test_page_metrics(spark):
    rows = [(n, "小红书", "u", html) for n, (html, _) in enumerate(PAGES)]
    rows += [(98, "抖音", "https://www.xiaohongshu.com/x", '"likes":1'), (99, "抖音", "u", '"likes":1')]
    pages = spark.createDataFrame(rows, "page_id int, platform string, url string, html string")
    found = page_metrics(pages).orderBy("page_id").collect()
    values = [(r["like_count"], r["comment_count"], r["collect_count"], r["outcome"]) for r in found]
    assert values[:-2] == [expected for _, expected in PAGES]
    assert values[-2:] == [(1, None, None, "ok"), (None, None, None, "unsupported")]


def test_two_null_rules_of_interactions(spark):
    rows = spark.createDataFrame(
        [(1, 2, 3, 4), (1, None, 3, 4)],
        "like_count bigint, comment_count bigint, collect_count bigint, share_count bigint",
    )
    found = rows.select(interactions().alias("a"), interactions_or_zero().alias("b")).collect()
    assert [tuple(r) for r in found] == [(10, 10), (8, 0)]


def test_report_texts(one):
    assert one(report.minute(F.col("t")), t="2024-01-02T03:04:05T") == "2024-01-02 03:04"
    assert one(report.minute(F.col("t")), t="") == "-"
    assert one(report.truncated(F.col("t"), 3), t="一二三四") == "一二三..."
    assert one(report.initial(F.col("t")), t="ab") == "A"
    assert one(report.initial(F.col("t")), t=None) == "?"
    first, more, joined = report.tag_summary(F.col("t"))
    assert one(F.array(first, more, joined), t="a，b, c") == ["a", "+2", "a、b、c"]
    assert one(F.array(first, more, joined), t="") == ["-", "", ""]


def test_texts_with_and_without_odd_characters_are_judged_alike(spark):
    from engagement.functions.contacts import email
    from engagement.functions.links import LINK_PUNCTUATION, first_link
    from engagement.functions.text import SPACE_CLASS, drop_whitespace, has_whitespace, strip

    links = [None, "", "http://", "https://a/b.", "https://a/b。", "https://a b", "x https://a/,", "https://a\n", "https://a,https://b", "https://a\u3000https://b", "HTTP://a", " https://a)", "ahttps://b", "https://\x7f a"]
    texts = [*links, "a@b.co", "a@b", "@b.co", "a@@b.co", "a b@c.co", "a\u2028@b.co", "é@b.co", "a@b.co\n", "a@b.\u3000"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    t, part = F.col("t"), f"[^@{SPACE_CLASS}]+"
    parts = F.regexp_extract_all(t, F.lit(f"(?:^|[{SPACE_CLASS}])(https?://[^{SPACE_CLASS}]*)"), F.lit(1))
    searched = F.coalesce(F.trim(F.get(parts, 0), F.lit(LINK_PUNCTUATION)), strip(t))
    low = F.lower(strip(t))
    pairs = [
        (first_link(t), searched),
        (has_whitespace(t), t.rlike(f"[{SPACE_CLASS}]")),
        (drop_whitespace(t), F.regexp_replace(t, f"[{SPACE_CLASS}]+", "")),
        (email(t)["reason"].isNotNull(), (low != "") & ~low.rlike(rf"^{part}@{part}\.{part}\z")),
    ]
    for found, expected in pairs:
        assert rows.where(~found.eqNullSafe(expected)).collect() == []


def test_plain_link_is_not_searched(spark):
    plan = spark.range(1).select(first_plain().alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("RLIKE") < plan.index("regexp_extract_all")


def first_plain():
    from engagement.functions.links import first_link

    return first_link(F.concat(F.lit("https://a/"), F.col("id").cast("string")))

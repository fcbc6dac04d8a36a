"""The model's tables as views of the test tables, and the inputs of the single jobs.

All of it is derived by Spark from whole tables; nothing is made up row by row.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import ContentIdRule, with_canonical_url
from ..operators.metrics import EVENTS
from ..schemas import CONTENT_METRICS, CONTENTS, CREATORS, PROJECTS

AS_OF = "1998-08-01"
NOW = "2024-06-01 00:00:00"

# How the links of the test pages spell an id.
PAGE_ID_RULES = (
    ContentIdRule("net", "example.net", markers=("en", "fr", "de", "es")),
    ContentIdRule("com", "example.com", last_of=1),
)


class Tables:
    """Lazy views over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def creators(self) -> DataFrame:
        key = F.col("c_custkey")
        text = key.cast("string")
        day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("id"),
                F.col("c_name").alias("name"),
                F.col("c_mktsegment").alias("platform"),
                text.alias("account_id"),
                F.lit("").alias("profile_url"),
                F.when(key % 4 == 0, "")
                .when(key % 4 == 1, "美食")
                .when(key % 4 == 2, "美食、旅游")
                .otherwise("科技,音乐、教育")
                .alias("category"),
                F.floor(F.abs("c_acctbal")).cast("bigint").alias("followers_count"),
                F.when(key % 3 == 0, F.concat(F.lit("wx"), text)).otherwise("").alias("wechat"),
                F.when(key % 5 == 0, F.concat(F.lit("138"), F.lpad(text, 8, "0"))).otherwise("").alias("phone"),
                F.when(key % 7 == 0, F.concat(F.lit("c"), text, F.lit("@example.com")))
                .otherwise("")
                .alias("email"),
                F.lit("").alias("other_contact"),
                F.col("n_name").alias("owner"),
                F.when(F.col("c_acctbal") < 0, "停用").otherwise("正常").alias("status"),
                F.lit("").alias("remark"),
                F.concat(F.lit("2024-01-"), day, F.lit(" 08:30:15")).alias("created_at"),
                F.concat(F.lit("2024-01-"), day, F.lit("T08:30:15")).alias("updated_at"),
            )
            .select(*CREATORS)
        )

    def projects(self) -> DataFrame:
        key = F.col("n_nationkey").cast("bigint")
        return (
            self.raw("nation")
            .select(
                key.alias("id"),
                F.col("n_name").alias("name"),
                F.when(F.col("n_regionkey") == 0, "")
                .otherwise(F.concat(F.lit("P"), key.cast("string")))
                .alias("project_code"),
                F.lit("进行中").alias("status"),
                F.lit("").alias("owner"),
                F.lit("").alias("start_date"),
                F.lit("").alias("end_date"),
                F.lit("").alias("description"),
                F.lit("2024-01-01 00:00:00").alias("created_at"),
                F.lit("2024-01-01 00:00:00").alias("updated_at"),
            )
            .select(*PROJECTS)
        )

    def contents(self) -> DataFrame:
        key = F.col("o_orderkey")
        day = F.col("o_orderdate").cast("date").cast("string")
        url = F.concat(F.lit("https://m.example.com/o/"), key.cast("string"), F.lit("?s=1"))
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                key.alias("id"),
                F.concat(F.lit("Order "), key.cast("string"), F.lit(" "), "o_orderpriority").alias("title"),
                F.col("o_custkey").alias("influencer_id"),
                F.when(key % 4 != 0, key % 25).alias("project_id"),
                F.col("c_mktsegment").alias("platform"),
                url.alias("content_url"),
                F.concat(F.lit("https://example.com/o/"), key.cast("string")).alias("canonical_url"),
                F.lit("").alias("platform_content_id"),
                day.alias("published_at"),
                F.lit("视频").alias("content_type"),
                F.col("o_orderpriority").alias("owner"),
                F.when(F.col("o_orderstatus") == "F", "作废").otherwise("正常").alias("status"),
                F.lit("").alias("remark"),
                day.alias("created_at"),
                day.alias("updated_at"),
            )
            .select(*CONTENTS)
        )

    def metrics(self) -> DataFrame:
        failed, ok = F.col("collect_count") > 0, F.col("share_count") > 0
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("content_id"))
            .agg(
                F.sum(F.col("l_quantity").cast("bigint")).alias("view_count"),
                F.count("*").alias("like_count"),
                F.sum(F.col("l_linenumber").cast("bigint")).alias("comment_count"),
                F.count_if(F.col("l_returnflag") == "R").alias("collect_count"),
                F.count_if(F.col("l_linestatus") == "F").alias("share_count"),
            )
            .withColumns(
                {
                    "data_source": F.lit("手动"),
                    "sync_status": F.when(failed, "同步失败").when(ok, "同步成功").otherwise("待同步"),
                    "last_sync_at": F.lit(""),
                    "next_sync_at": F.lit(""),
                    "failed_reason": F.lit(""),
                    "updated_at": F.lit(""),
                }
            )
            .select(*CONTENT_METRICS)
        )

    def star(self):
        """Arguments of the star join: contents, creators, projects, metrics."""
        return self.contents(), self.creators(), self.projects(), self.metrics()

    def dated_projects(self) -> DataFrame:
        """Orders as projects with running times, some of them broken or open."""
        key = F.col("o_orderkey")
        start = F.col("o_orderdate").cast("date")
        days = F.when(key % 11 == 0, -5).otherwise((key % 120).cast("int"))
        end = F.when(key % 7 != 0, F.date_add(start, days))
        first_day = start.cast("string")
        return self.raw("orders").select(
            key.alias("id"),
            F.concat(F.lit("Project "), key.cast("string")).alias("name"),
            F.when(key % 10 != 0, F.concat(F.lit("P"), (key % 1000).cast("string")))
            .otherwise("")
            .alias("project_code"),
            F.when(F.col("o_orderstatus") == "F", "已归档").otherwise("进行中").alias("status"),
            F.col("o_orderpriority").alias("owner"),
            first_day.alias("start_date"),
            F.coalesce(end.cast("string"), F.lit("")).alias("end_date"),
            F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("note "), "o_orderpriority")).alias("description"),
            first_day.alias("created_at"),
            first_day.alias("updated_at"),
        )

    def part_creators(self) -> DataFrame:
        """Parts as creators: many share a name and a platform."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("platform"),
            F.when(key % 3 == 0, F.col("p_type")).otherwise("").alias("account_id"),
            F.concat_ws("", "p_brand", F.lit("、 "), "p_type", F.lit("，"), "p_brand").alias("category"),
            F.col("p_size").cast("bigint").alias("followers_count"),
            F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("created_at"),
        )

    def creator_references(self) -> DataFrame:
        """Parts as references to creators: by id, by label, by name, and some misses."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("ref_id"),
            F.when(key % 2 == 0, F.col("p_brand")).otherwise("").alias("platform"),
            F.when(key % 10 == 1, key + 7).alias("creator_id"),
            F.when(key % 10 == 2, "nobody")
            .when(key % 5 == 0, F.concat("p_name", F.lit(" / "), "p_type"))
            .otherwise(F.concat(F.lit("　"), "p_name", F.lit(" ")))
            .alias("creator_text"),
        )

    def metric_events(self) -> DataFrame:
        return as_metric_events(self.raw("events"))

    def link_texts(self) -> DataFrame:
        """Page links the way people paste them."""
        key, url = F.col("page_id") % 7, F.col("url")
        raw = (
            F.when(key == 1, F.concat(F.lit("看看 "), url, F.lit("。 谢谢")))
            .when(key == 2, F.upper(url))
            .when(key == 3, F.regexp_replace(url, "^https?://", ""))
            .when(key == 4, F.concat(url, F.lit("/;p=1?q=2")))
            .when((key == 5) & (F.col("page_id") % 2 == 1), F.replace(url, F.lit(".example."), F.lit("？q.example.")))
            .when(key == 5, F.concat(F.lit("　"), url, F.lit("//　")))
            .when(key == 6, F.concat(F.lit("(x)\n"), url, F.lit(",")))
            .otherwise(url)
        )
        return self.raw("pages").select(F.col("page_id").alias("id"), raw.alias("raw_url"))

    def platform_links(self) -> DataFrame:
        """Page links moved to the hosts and paths of the platforms."""
        key = F.col("page_id") % 8
        slug = F.concat(F.lit("x"), F.regexp_extract("url", "/([0-9]+)", 1))
        platform = (
            F.when(key == 0, "小红书").when(key == 3, "B站").when(key == 5, "微博").otherwise("其他")
        )
        url = (
            F.when(key == 0, F.concat(F.lit("explore/"), slug))
            .when(key == 1, F.concat(F.lit("https://www.xiaohongshu.com/discovery/item/"), slug))
            .when(key == 2, F.concat(F.lit("https://m.bilibili.com/video/"), slug, F.lit("/?p=1")))
            .when(key == 3, F.concat(F.lit("https://b23.tv/a/BV"), slug))
            .when(key == 4, F.concat(F.lit("https://www.douyin.com/user/note/"), slug))
            .when(key == 5, F.concat(F.lit("https://m.weibo.cn/u/"), slug, F.lit("/")))
            .when(key == 6, F.concat(F.lit("https://weibo.com/"), slug))
            .otherwise(F.col("url"))
        )
        return self.raw("pages").select(
            F.col("page_id").alias("id"), platform.alias("platform"), url.alias("content_url")
        )

    def page_contents(self) -> DataFrame:
        """Pages as contents, identified by their links."""
        return with_canonical_url(
            self.raw("pages").select(
                F.col("page_id").alias("id"),
                F.lit("网页").alias("platform"),
                F.col("url").alias("content_url"),
                F.lit("").alias("platform_content_id"),
            )
        )

    def entangled_contents(self) -> DataFrame:
        """Pages as contents that collide by site and by number, in long chains."""
        return self.raw("pages").select(
            F.col("page_id").alias("id"),
            F.regexp_extract("url", "^https?://([^/]*)", 1).alias("content_url"),
            F.lit("").alias("canonical_url"),
            F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("platform"),
            (F.regexp_extract("url", "/([0-9]+)", 1).cast("bigint") % 100)
            .cast("string")
            .alias("platform_content_id"),
        )

    def creator_lines(self) -> DataFrame:
        """Customers as JSON records, most of them breaking one rule."""
        key = F.col("c_custkey")
        case = key % 18
        text = key.cast("string")
        name = (
            F.when(case.isin(1, 2), "　 ")
            .when(case == 11, F.concat(F.lit("dup"), F.col("c_nationkey").cast("string")))
            .otherwise(F.concat(F.lit(" "), "c_name"))
        )
        fields = [
            ("name", name),
            ("platform", F.when(case == 3, "").when(case == 4, "MySpace").when(case == 8, "微博").otherwise("抖音")),
            ("category", F.when(case == 1, "美食、钓鱼").otherwise("美食, 旅游，美食")),
            ("status", F.when(case == 5, "休息").when(case == 15, "停用").otherwise("")),
            ("profile_url", F.when(case == 8, "https://douyin.com/u").otherwise("https://www.douyin.com/u")),
            ("phone", F.when(case == 9, "12800138000").otherwise("+86 138-0013-8000")),
            ("email", F.when(case == 10, "a@b").otherwise(" A@B.CO ")),
        ]
        followers = (
            F.when(case == 6, '"followers_count": "3.7"')
            .when(case == 7, '"followers_count": -1')
            .when(case == 12, '"followers_count": 3.7')
            .when(case == 13, F.concat(F.lit('"followers": '), text))
            .when(case == 14, F.concat(F.lit('"followers_count": null, "followers": '), text))
            .otherwise(F.concat(F.lit('"followers_count": " '), text, F.lit('"')))
        )
        members = [F.concat(F.lit(f'"{n}": "'), value, F.lit('"')) for n, value in fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *members, followers), F.lit("}"))
        line = (
            F.when(case == 16, F.concat(body, F.lit(" tail")))
            .when(case == 17, F.concat(F.lit("["), body, F.lit("]")))
            .when(key % 900 == 0, F.concat(body, F.repeat(F.lit(" "), 100_000)))
            .otherwise(body)
        )
        return self.raw("customer").select(key.alias("seq"), line.alias("body"))

    def project_lines(self) -> DataFrame:
        """Orders as JSON project records."""
        key = F.col("id")
        fields = [
            ("name", F.when(key % 13 == 0, " ").otherwise(F.col("name"))),
            ("project_code", F.col("project_code")),
            ("status", F.when(key % 17 == 0, "暂停").when(key % 5 == 0, "归档").otherwise("")),
            ("start_date", F.when(key % 19 == 0, "1998-2-30").otherwise(F.col("start_date"))),
            ("end_date", F.when(key % 23 == 0, "soon").otherwise(F.col("end_date"))),
        ]
        members = [F.concat(F.lit(f'"{n}": "'), value, F.lit('"')) for n, value in fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
        return self.dated_projects().select(key.alias("seq"), body.alias("body"))

    def content_lines(self) -> DataFrame:
        """Orders as JSON content records."""
        key = F.col("o_orderkey")
        text = key.cast("string")
        members = [
            F.concat(F.lit('"title": "'), F.when(key % 29 == 0, "").otherwise(F.concat(F.lit("Order "), text)), F.lit('"')),
            F.when(key % 31 == 0, F.lit('"influencer_id": ""'))
            .when(key % 37 == 0, F.lit('"influencer_id": "x"'))
            .when(key % 41 == 0, F.lit('"influencer_id": 999999999'))
            .otherwise(F.concat(F.lit('"influencer_id": '), (F.col("o_custkey") + 1).cast("string"))),
            F.when(key % 43 == 0, F.lit('"project_id": -2'))
            .when(key % 47 == 0, F.lit('"project_id": 77'))
            .otherwise(F.lit('"project_id": null')),
            F.concat(
                F.lit('"content_url": "https://www.douyin.com/video/'),
                F.when(key % 10 == 0, (key % 400).cast("string")).otherwise(text),
                F.lit("?from="),
                text,
                F.lit('"'),
            ),
            F.when(key % 53 == 0, F.lit('"published_at": null')).otherwise(F.lit('"published_at": "2024-01-01"')),
            F.when(key % 59 == 0, F.lit('"status": "草稿"')).otherwise(F.lit('"status": ""')),
            F.when(key % 61 == 0, F.lit('"content_type": "音频"')).otherwise(F.lit('"content_type": "图文"')),
            F.when(key % 67 == 0, F.lit('"view_count": "many"')).otherwise(F.concat(F.lit('"view_count": '), text)),
            F.when(key % 71 == 0, F.lit('"share_count": -1')).otherwise(F.lit('"share_count": "12"')),
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
        return self.raw("orders").select(key.alias("seq"), body.alias("body"))

    def contacts(self) -> DataFrame:
        """Customers with contacts in many spellings."""
        key = F.col("c_custkey")
        digits = F.lpad(key.cast("string"), 8, "0")
        phone = (
            F.when(key % 6 == 0, "")
            .when(key % 6 == 1, F.concat(F.lit("138"), digits))
            .when(key % 6 == 2, F.concat(F.lit(" +86 139-"), digits))
            .when(key % 6 == 3, F.concat(F.lit("0086"), F.lit("177"), digits))
            .when(key % 6 == 4, F.concat(F.lit("128"), digits))
            .otherwise(F.concat(F.lit("+860086138"), digits))
        )
        email = (
            F.when(key % 5 == 0, "　")
            .when(key % 5 == 1, F.concat(F.lit(" User"), digits, F.lit("@Example.COM ")))
            .when(key % 5 == 2, F.concat(F.lit("user "), digits, F.lit("@example.com")))
            .when(key % 5 == 3, F.concat(F.lit("user@"), digits))
            .otherwise(F.concat(F.lit("u@"), digits, F.lit(".x.org")))
        )
        host = (
            F.when(key % 7 == 0, "HTTPS://Space.Bilibili.com/")
            .when(key % 7 == 1, "http://bilibili.com:80/")
            .when(key % 7 == 2, "ftp://bilibili.com/")
            .when(key % 7 == 3, "https://notbilibili.com/")
            .when(key % 7 == 4, "bilibili.com/")
            .when(key % 7 == 5, "https://b23.tv/a b/")
            .otherwise("https://b23.tv?u=")
        )
        return self.raw("customer").select(
            key.alias("id"),
            phone.alias("phone"),
            email.alias("email"),
            F.concat(host, key.cast("string")).alias("profile_url"),
            F.when(key % 4 == 0, "其他").when(key % 4 == 1, "未知").otherwise("B站").alias("platform"),
        )

    def tagged(self) -> DataFrame:
        """Parts with joined tags in mixed separators, some unknown."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("id"),
            F.when(key % 5 == 0, F.concat(F.lit("美食、"), "p_type", F.lit("，"), "p_brand"))
            .when(key % 5 == 1, F.lit(" 科技 ,　音乐，科技、"))
            .when(key % 5 == 2, F.lit("、，,"))
            .when(key % 5 == 3, F.lit("美妆,时尚,美妆,汽车"))
            .otherwise(F.lit("美食、 美食"))
            .alias("category"),
        )

    def metric_pages(self) -> DataFrame:
        """Pages with counters written into them in the supported spellings."""
        key = F.col("page_id")
        n = key.cast("string")
        mark = (
            F.when(key % 9 == 0, F.concat(F.lit('{"likedCount" : "'), n, F.lit('.5万", "comments":'), n, F.lit("}")))
            .when(key % 9 == 1, F.concat(F.lit("{'LIKES': "), n, F.lit(", 'favorites':'1,"), n, F.lit("+'}")))
            .when(key % 9 == 2, F.concat(F.lit("点 赞： "), n, F.lit("k 评论12")))
            .when(key % 9 == 3, F.concat(n, F.lit(" 收 藏")))
            .when(key % 9 == 4, F.lit("小红书 验证"))
            .when(key % 9 == 5, F.concat(F.lit('"likedCount":"none","likeCount":'), n, F.lit(".9")))
            .when(key % 9 == 6, F.concat(F.lit("赞,,, "), n, F.lit("赞")))
            .otherwise("")
        )
        return self.raw("pages").select(
            key.alias("page_id"),
            F.when(key % 9 == 8, "抖音").otherwise("小红书").alias("platform"),
            "url",
            F.concat(mark, "html").alias("html"),
        )

    def old_creators(self) -> DataFrame:
        """Customers as an extract of an older layout."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("platform"),
            F.lit("").alias("category"),
            F.when(key % 3 != 0, key * 10).cast("int").alias("followers"),
            F.when(key % 2 == 0, 0).otherwise(key).cast("bigint").alias("followers_count"),
            F.when(key % 6 == 0, "待建联")
            .when(key % 6 == 1, "合作中")
            .when(key % 6 == 2, "")
            .when(key % 6 == 4, "停用")
            .when(key % 6 == 5, "正常")
            .alias("status"),
            F.when(key % 4 != 0, "2023-05-05 10:00:00").alias("created_at"),
            F.when(key % 5 == 0, "").when(key % 5 == 1, "2023-06-06 10:00:00").alias("updated_at"),
        )

    def old_contents(self) -> DataFrame:
        """Platform links as contents, with the link fields filled for some of them."""
        key = F.col("id") % 3
        return self.platform_links().select(
            "id",
            F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"),
            F.lit(1).cast("bigint").alias("influencer_id"),
            F.lit(None).cast("bigint").alias("project_id"),
            "platform",
            "content_url",
            F.when(key == 0, "kept").when(key == 1, "").alias("canonical_url"),
            F.when(key == 1, "kept").otherwise("").alias("platform_content_id"),
            F.lit("2023-05-05").alias("published_at"),
        )


def as_metric_events(events: DataFrame) -> DataFrame:
    """Rows of the events table as metric events; works on a stream, too."""
    kind = (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type") == "click", "sync_ok")
        .when(F.col("event_type") == "error", "sync_fail")
        .otherwise("edit")
    )
    amount = F.floor(F.col("value")).cast("bigint")
    return events.select(
        F.col("user_id").alias("content_id"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        (amount * 10).alias("view_count"),
        F.when(F.col("event_id") % 3 != 0, amount).alias("like_count"),
        F.when(F.col("event_id") % 4 != 0, amount + 1).alias("comment_count"),
        F.when(F.col("event_id") % 5 != 0, amount + 2).alias("collect_count"),
        (amount + 3).alias("share_count"),
        F.when(F.col("event_type") == "purchase", "导入").otherwise("").alias("data_source"),
        F.when(F.col("event_id") % 2 == 0, "待同步").alias("sync_status"),
        F.when(F.col("event_id") % 2 == 0, "timeout").alias("failed_reason"),
    ).select(*EVENTS)

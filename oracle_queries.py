"""DuckDB SQL giving the expected rows of each registered query.

Written from the rules, over the same test tables; ``with_views`` puts the views a query
needs in front of it.
"""

AS_OF = "DATE '1998-08-01'"

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text):
    return f"regexp_replace(coalesce({text}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def fold(text):
    return f"translate({text}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


VIEWS = {
    "creators": """
        SELECT c_custkey AS id, c_name AS name, c_mktsegment AS platform,
            CAST(c_custkey AS VARCHAR) AS account_id, '' AS profile_url,
            CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '美食' WHEN 2 THEN '美食、旅游'
                ELSE '科技,音乐、教育' END AS category,
            CAST(floor(abs(c_acctbal)) AS BIGINT) AS followers_count,
            CASE WHEN c_custkey % 3 = 0 THEN concat('wx', c_custkey) ELSE '' END AS wechat,
            CASE WHEN c_custkey % 5 = 0
                THEN concat('138', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) ELSE '' END AS phone,
            CASE WHEN c_custkey % 7 = 0 THEN concat('c', c_custkey, '@example.com') ELSE '' END AS email,
            '' AS other_contact, n_name AS owner,
            CASE WHEN c_acctbal < 0 THEN '停用' ELSE '正常' END AS status, '' AS remark,
            concat('2024-01-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'), ' 08:30:15') AS created_at,
            concat('2024-01-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'), 'T08:30:15') AS updated_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "projects": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
            CASE WHEN n_regionkey = 0 THEN '' ELSE concat('P', n_nationkey) END AS project_code
        FROM nation""",
    "contents": """
        SELECT o_orderkey AS id, concat('Order ', o_orderkey, ' ', o_orderpriority) AS title,
            o_custkey AS influencer_id,
            CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 25 END AS project_id,
            c_mktsegment AS platform,
            concat('https://m.example.com/o/', o_orderkey, '?s=1') AS content_url,
            concat('https://example.com/o/', o_orderkey) AS canonical_url,
            '' AS platform_content_id,
            strftime(o_orderdate, '%Y-%m-%d') AS published_at, '视频' AS content_type,
            o_orderpriority AS owner,
            CASE WHEN o_orderstatus = 'F' THEN '作废' ELSE '正常' END AS status, '' AS remark,
            strftime(o_orderdate, '%Y-%m-%d') AS created_at,
            strftime(o_orderdate, '%Y-%m-%d') AS updated_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "metrics": """
        SELECT *, CASE WHEN collect_count > 0 THEN '同步失败' WHEN share_count > 0 THEN '同步成功'
                ELSE '待同步' END AS sync_status
        FROM (SELECT l_orderkey AS content_id,
                CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS view_count,
                count(*) AS like_count,
                CAST(sum(l_linenumber) AS BIGINT) AS comment_count,
                count(*) FILTER (l_returnflag = 'R') AS collect_count,
                count(*) FILTER (l_linestatus = 'F') AS share_count
            FROM lineitem GROUP BY 1)""",
    "details": """
        SELECT c.*, i.name AS influencer_name, coalesce(p.name, '') AS project_name,
            coalesce(m.view_count, 0) AS view_count, coalesce(m.like_count, 0) AS like_count,
            coalesce(m.comment_count, 0) AS comment_count,
            coalesce(m.collect_count, 0) AS collect_count, coalesce(m.share_count, 0) AS share_count,
            CASE WHEN m.content_id IS NOT NULL THEN '手动' END AS data_source, m.sync_status,
            CASE WHEN m.content_id IS NOT NULL THEN '' END AS last_sync_at,
            CASE WHEN m.content_id IS NOT NULL THEN '' END AS failed_reason,
            coalesce(m.like_count, 0) + coalesce(m.comment_count, 0)
                + coalesce(m.collect_count, 0) + coalesce(m.share_count, 0) AS interaction_count
        FROM contents c JOIN creators i ON i.id = c.influencer_id
        LEFT JOIN projects p ON p.id = c.project_id
        LEFT JOIN metrics m ON m.content_id = c.id""",
    "dated": """
        SELECT id, name, project_code, status, owner, start_date,
            coalesce(strftime(end_day, '%Y-%m-%d'), '') AS end_date, description,
            start_date AS created_at, start_date AS updated_at, start_day, end_day
        FROM (SELECT o_orderkey AS id, concat('Project ', o_orderkey) AS name,
                CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('P', o_orderkey % 1000) END AS project_code,
                CASE WHEN o_orderstatus = 'F' THEN '已归档' ELSE '进行中' END AS status,
                o_orderpriority AS owner, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
                CAST(o_orderdate AS DATE) AS start_day,
                CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) - 5
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) END AS end_day,
                CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('note ', o_orderpriority) END AS description
            FROM orders)""",
    "lived": f"""
        SELECT * REPLACE (CASE WHEN status = '已归档' THEN status WHEN end_day < start_day THEN NULL
                WHEN {AS_OF} < start_day THEN '未开始' WHEN {AS_OF} > end_day THEN '已结束'
                ELSE '进行中' END AS status),
            CASE WHEN status <> '已归档' AND end_day < start_day THEN 'end_before_start' END AS status_error
        FROM dated""",
    "part_creators": """
        SELECT p_partkey AS id, p_name AS name, p_brand AS platform,
            CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS account_id,
            concat(p_brand, '、 ', p_type, '，', p_brand) AS category,
            concat('2024-01-', lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0')) AS created_at
        FROM part""",
    "entangled": """
        SELECT page_id AS id, regexp_extract(url, '^https?://([^/]*)', 1) AS content_url,
            regexp_extract(url, '/(en|fr|de|es)/', 1) AS platform,
            CAST(CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) % 100 AS VARCHAR) AS platform_content_id
        FROM pages""",
    "metric_events": """
        SELECT user_id AS content_id, event_id AS seq,
            CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'ok'
                WHEN 'error' THEN 'fail' ELSE 'edit' END AS kind,
            strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, event_type,
            CAST(floor(value) AS BIGINT) AS amount
        FROM events""",
}

NEEDS = {
    "details": ["contents", "creators", "projects", "metrics"],
    "lived": ["dated"],
}


def with_views(names, body):
    ordered = []
    for name in names.split():
        for view in (*NEEDS.get(name, ()), name):
            if view not in ordered:
                ordered.append(view)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered) + "\n" + body


def page_link(raw):
    """Canonical form of ``raw`` for the spellings the test links use."""
    first = f"regexp_extract({raw}, '(^|{SPACE})(https?://[^{SPACE[1:]}*)', 2)"
    link = f"CASE WHEN {first} <> '' THEN trim({first}, '，,。)') ELSE {strip(raw)} END"
    return f"""
        CASE WHEN NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')
            THEN rtrim(link, '/')
        ELSE concat(
            regexp_replace(lower(regexp_extract(link, '^[^:]*://[^/?#]*')), '://m\\.', '://'),
            rtrim(regexp_replace(
                regexp_extract(link, '^[^:]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/')) END
        """, link


CANONICAL, LINK = page_link("raw_url")

ORACLE = {}

CREATOR_COLUMNS = (
    "id, name, platform, account_id, profile_url, category, followers_count, wechat, phone, "
    "email, other_contact, owner, status, remark, created_at, updated_at"
)
DETAIL_COLUMNS = (
    "id, title, influencer_id, project_id, platform, content_url, canonical_url, "
    "platform_content_id, published_at, content_type, owner, status, remark, created_at, "
    "updated_at, influencer_name, project_name, view_count, like_count, comment_count, "
    "collect_count, share_count, data_source, sync_status, last_sync_at, failed_reason, "
    "interaction_count"
)
PROJECT_COLUMNS = (
    "id, name, project_code, status, owner, start_date, end_date, description, created_at, updated_at"
)

ORACLE["src_3_page_scan"] = "SELECT page_id, url, sha256(html) AS html_sha256 FROM pages"

ROLLUP = """
    SELECT c.platform, count(*) AS content_count,
        CAST(coalesce(sum(m.view_count), 0) AS BIGINT) AS view_count
    FROM contents c LEFT JOIN metrics m ON m.content_id = c.id GROUP BY c.platform"""
ORACLE["agg_2_platform_rollup"] = with_views("contents metrics", ROLLUP)

ORACLE["flt_1_keyword"] = with_views("creators", f"""
    SELECT id, name, owner FROM creators
    WHERE {fold('name')} LIKE '%OMER#%01_%' OR {fold('owner')} LIKE '%OMER#%01_%'""")
ORACLE["flt_2_platform"] = with_views(
    "creators", "SELECT id, platform FROM creators WHERE platform = 'BUILDING'")
ORACLE["flt_3_range"] = with_views("details", """
    SELECT c.id, coalesce(m.view_count, 0) AS view_count,
        coalesce(m.like_count + m.comment_count + m.collect_count + m.share_count, 0) AS interaction_count
    FROM contents c LEFT JOIN metrics m ON m.content_id = c.id
    WHERE coalesce(m.view_count, 0) <= 60
        AND coalesce(m.like_count + m.comment_count + m.collect_count + m.share_count, 0) BETWEEN 0 AND 12""")
ORACLE["flt_4_project_link"] = with_views(
    "contents", "SELECT id, project_id FROM contents WHERE project_id IS NULL OR project_id = 7")
ORACLE["flt_5_derived_status"] = with_views(
    "lived", "SELECT id, status, end_date FROM lived WHERE status = '已结束'")
ORACLE["flt_6_tag"] = with_views(
    "part_creators", f"SELECT id, category FROM part_creators WHERE {fold('category')} LIKE '%ECONOMY%'")

ORACLE["flt_6_tag_array"] = with_views("part_creators", f"""
    SELECT id, 'tag' AS form FROM part_creators WHERE platform = 'Brand#1'
    UNION ALL SELECT id, 'keyword' FROM part_creators WHERE {fold('category')} LIKE '%BRAND#1%'""")

ORACLE["prj_1_content_detail"] = with_views("details", f"SELECT {DETAIL_COLUMNS} FROM details")
ORACLE["prj_2_interactions"] = with_views("contents metrics", """
    SELECT c.id,
        coalesce(nullif(like_count, 4), 0) + coalesce(comment_count, 0) + coalesce(collect_count, 0)
            + coalesce(share_count, 0) AS interaction_count,
        coalesce(nullif(like_count, 4) + comment_count + collect_count + share_count, 0)
            AS recent_interaction_count
    FROM contents c LEFT JOIN metrics m ON m.content_id = c.id""")
ORACLE["prj_3_row_defaults"] = with_views("creators", """
    SELECT id, CASE WHEN status = '正常' THEN followers_count ELSE 0 END AS followers_count FROM creators""")

ORACLE["search_1_creators"] = with_views("creators", f"""
    SELECT {CREATOR_COLUMNS} FROM creators
    WHERE {fold('name')} LIKE '%CUSTOMER#%' AND platform = 'MACHINERY' AND category LIKE '%美食%'
        AND {fold('owner')} LIKE '%NATION_1%' AND followers_count BETWEEN 500 AND 9000""")
ORACLE["search_2_projects"] = with_views("lived", f"""
    SELECT {PROJECT_COLUMNS}, status_error FROM lived
    WHERE ({fold('name')} LIKE '%P1%' OR {fold('project_code')} LIKE '%P1%')
        AND {fold('owner')} LIKE '%H%' AND status = '进行中'""")
ORACLE["search_3_contents"] = with_views("details", f"""
    SELECT {DETAIL_COLUMNS} FROM details
    WHERE ({fold('title')} LIKE '%-URGENT%' OR {fold('content_url')} LIKE '%-URGENT%'
            OR {fold('influencer_name')} LIKE '%-URGENT%')
        AND platform = 'BUILDING' AND project_id IS NULL
        AND view_count BETWEEN 10 AND 200 AND interaction_count BETWEEN 5 AND 60""")
ORACLE["search_4_lookup"] = with_views("details", """
    SELECT key, CASE WHEN bad THEN 'bad_id' WHEN d.id IS NULL THEN 'not_found' ELSE 'ok' END AS lookup,
        d.id, d.title, d.influencer_name, d.interaction_count
    FROM (SELECT l_orderkey, l_orderkey % 11 = 0 AS bad,
            CASE WHEN l_orderkey % 11 = 0 THEN concat(l_orderkey, 'x')
                WHEN l_orderkey % 7 = 0 THEN CAST(-l_orderkey - 1 AS VARCHAR)
                ELSE CAST(l_orderkey AS VARCHAR) END AS key
        FROM lineitem) k
    LEFT JOIN details d ON d.id = k.l_orderkey AND NOT bad AND k.l_orderkey % 7 <> 0""")

ORACLE["search_4_lookup_creators"] = with_views("creators", """
    SELECT CAST(o_custkey * 2 AS VARCHAR) AS key, CASE WHEN id IS NULL THEN 'not_found' ELSE 'ok' END AS lookup,
        id, name, followers_count
    FROM orders LEFT JOIN creators ON id = o_custkey * 2""")
ORACLE["search_4_lookup_projects"] = with_views("lived", """
    SELECT concat(' ', l_orderkey * 2) AS key, CASE WHEN id IS NULL THEN 'not_found' ELSE 'ok' END AS lookup,
        id, status, status_error
    FROM lineitem LEFT JOIN lived ON id = l_orderkey * 2""")

ORACLE["jn_1_star"] = with_views("details", """
    SELECT c.id, i.name AS influencer_name, p.name AS project_name, m.view_count
    FROM contents c JOIN creators i ON i.id = c.influencer_id
    LEFT JOIN projects p ON p.id = c.project_id LEFT JOIN metrics m ON m.content_id = c.id""")
ORACLE["jn_1_bucketed_star"] = ORACLE["jn_1_star"]
ORACLE["jn_2_contents_metrics"] = with_views("contents metrics", """
    SELECT c.id, m.view_count, m.sync_status
    FROM contents c LEFT JOIN metrics m ON m.content_id = c.id""")
ORACLE["jn_3_missing_references"] = with_views("contents creators projects", """
    SELECT id, influencer_id, project_id,
        CASE WHEN influencer_id NOT IN (SELECT id FROM creators) THEN 'creator_not_found'
            ELSE 'project_not_found' END AS reason
    FROM (SELECT id, influencer_id + 40 AS influencer_id, project_id * 2 AS project_id FROM contents)
    WHERE influencer_id NOT IN (SELECT id FROM creators)
        OR (project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM projects))""")
ORACLE["jn_4_stored_duplicates"] = with_views("part_creators", """
    SELECT a.id, 'insert' AS entry FROM part_creators a
    WHERE a.id % 2 = 1 AND EXISTS (SELECT 1 FROM part_creators b
        WHERE b.id % 2 = 0 AND b.name = a.name AND b.platform = a.platform)
    UNION ALL
    SELECT a.id, 'update' FROM part_creators a
    WHERE EXISTS (SELECT 1 FROM part_creators b
        WHERE b.id <> a.id AND b.name = a.name AND b.platform = a.platform)""")
ORACLE["jn_4_stored_projects"] = with_views("dated", """
    SELECT a.id, a.code AS project_code
    FROM (SELECT id, CASE WHEN id % 2 = 0 THEN project_code ELSE 'P7' END AS code FROM dated) a
    WHERE a.code <> '' AND EXISTS (SELECT 1 FROM dated b WHERE b.project_code = a.code AND b.id <> a.id)""")
ORACLE["jn_4_stored_contents"] = with_views("entangled", """
    SELECT a.id, a.content_url, a.platform, a.platform_content_id FROM entangled a
    WHERE EXISTS (SELECT 1 FROM entangled b WHERE b.id <> a.id AND (b.content_url = a.content_url
        OR (b.platform = a.platform AND b.platform_content_id = a.platform_content_id)))""")
ORACLE["jn_5_resolve_creators"] = with_views("part_creators", f"""
    , refs AS (
        SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS platform,
            CASE WHEN p_partkey % 10 = 1 THEN p_partkey + 7 END AS creator_id,
            CASE WHEN p_partkey % 10 = 2 THEN 'nobody'
                WHEN p_partkey % 5 = 0 THEN concat(p_name, ' / ', p_type) ELSE p_name END AS text
        FROM part),
    labels AS (
        SELECT *, CASE WHEN account_id = '' THEN name ELSE concat(name, ' / ', account_id) END AS label
        FROM part_creators)
    SELECT ref_id, platform, CASE WHEN creator_id IS NOT NULL THEN
            (SELECT max(l.id) FROM labels l WHERE l.id = creator_id AND (r.platform = '' OR l.platform = r.platform))
        ELSE coalesce(
            (SELECT arg_max(l.id, (l.created_at, l.id)) FROM labels l
                WHERE l.label = r.text AND (r.platform = '' OR l.platform = r.platform)),
            (SELECT arg_max(l.id, (l.created_at, l.id)) FROM labels l
                WHERE l.name = r.text AND (r.platform = '' OR l.platform = r.platform))) END AS resolved_id
    FROM refs r""").replace("\n\n    , refs", ", refs")

ORACLE["agg_1_totals"] = with_views("contents creators metrics lived", """
    SELECT (SELECT count(*) FROM creators) AS influencer_count,
        (SELECT count(*) FROM creators WHERE status = '正常') AS active_influencer_count,
        (SELECT count(*) FROM lived) AS project_count,
        (SELECT count(*) FROM lived WHERE status = '进行中') AS active_project_count,
        (SELECT count(status_error) FROM lived) AS status_error_count,
        (SELECT count(*) FROM contents) AS content_count,
        CAST(coalesce((SELECT sum(view_count) FROM metrics), 0) AS BIGINT) AS total_views,
        CAST(coalesce((SELECT sum(like_count + comment_count + collect_count + share_count) FROM metrics), 0)
            AS BIGINT) AS total_interactions""")
ORACLE["agg_1_one_pass"] = with_views("contents metrics lived", f"""
    SELECT 'totals' AS part, '' AS name, (SELECT count(*) FROM contents) AS content_count,
        CAST(sum(view_count) AS BIGINT) AS view_count,
        CAST(sum(like_count + comment_count + collect_count + share_count) AS BIGINT) AS total_interactions,
        (SELECT count(*) FROM lived WHERE status = '进行中') AS active_project_count
    FROM metrics
    UNION ALL SELECT 'platform', platform, content_count, view_count, NULL, NULL FROM ({ROLLUP})
    UNION ALL SELECT 'status', sync_status, count(*), NULL, NULL, NULL FROM metrics GROUP BY sync_status""")
ORACLE["agg_3_sync_rollup"] = with_views(
    "metrics", "SELECT sync_status, count(*) AS content_count FROM metrics GROUP BY sync_status")
ORACLE["agg_4_running_projects"] = with_views("lived", """
    SELECT count(*) FILTER (status = '进行中') AS active_project_count,
        count(status_error) AS status_error_count FROM lived""")
ORACLE["agg_5_result_count"] = with_views("details lived", f"""
    SELECT 'creators' AS list, count(*) AS row_count FROM creators
    WHERE {fold('name')} LIKE '%CUSTOMER#0000%' AND followers_count >= 1000
    UNION ALL SELECT 'projects', count(*) FROM lived WHERE status = '已归档'
    UNION ALL SELECT 'contents', count(*) FROM details
    WHERE ({fold('title')} LIKE '%LOW%' OR {fold('content_url')} LIKE '%LOW%'
            OR {fold('influencer_name')} LIKE '%LOW%')
        AND view_count >= 100 AND interaction_count <= 70""")
ORACLE["srt_1_recent_contents"] = with_views("details", """
    SELECT id, title, platform, published_at, influencer_name, project_name, view_count,
        interaction_count, coalesce(sync_status, '待同步') AS sync_status,
        row_number() OVER (ORDER BY published_at DESC, id DESC) AS position
    FROM details ORDER BY published_at DESC, id DESC LIMIT 5""")
ORACLE["srt_2_newest_first"] = with_views(
    "details", """SELECT id, created_at, title, row_number() OVER (ORDER BY created_at DESC, id DESC) AS position
    FROM details""")
ORACLE["srt_3_ranked_rollups"] = with_views("contents metrics", """
    SELECT 'platform' AS rollup, platform AS group_key, content_count, view_count,
        row_number() OVER (ORDER BY content_count DESC, view_count DESC, platform) AS position
    FROM (""" + ROLLUP + """)
    UNION ALL
    SELECT 'sync_status', sync_status, n, NULL, row_number() OVER (ORDER BY n DESC, sync_status)
    FROM (SELECT sync_status, count(*) AS n FROM metrics GROUP BY 1)""")


def as_texts(part, key, columns, rows):
    """Rows as (part, key, values), as the queries over several layouts give them."""
    values = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in columns)
    return f"SELECT '{part}' AS part, CAST({key} AS BIGINT) AS key, concat_ws('|', {values}) AS values FROM ({rows})"


def columns_of(text):
    return [name.strip() for name in text.split(",")]


METRIC_COLUMNS = (
    "content_id, view_count, like_count, comment_count, collect_count, share_count, "
    "data_source, sync_status, last_sync_at, next_sync_at, failed_reason, updated_at"
)
LOG_COLUMNS = "content_id, source, status, started_at, finished_at, raw_summary, error_message"
CONTENT_COLUMNS = (
    "id, title, influencer_id, project_id, platform, content_url, canonical_url, platform_content_id, "
    "published_at, content_type, owner, status, remark, created_at, updated_at"
)
TOTAL_COLUMNS = (
    "influencer_count, active_influencer_count, project_count, active_project_count, status_error_count, "
    "content_count, total_views, total_interactions"
)
RECENT_COLUMNS = (
    "id, title, platform, published_at, influencer_name, project_name, view_count, interaction_count, sync_status"
)


def body_of(key, views):
    """What follows the views in an expected query."""
    return ORACLE[key].removeprefix(with_views(views, ""))


ORACLE["snk_1_result_write"] = with_views("contents creators projects metrics lived details", " UNION ALL ".join([
    as_texts("totals", 1, columns_of(TOTAL_COLUMNS), f"""
        SELECT * REPLACE ((SELECT count(*) FROM projects) AS project_count,
            (SELECT count(*) FROM projects) AS active_project_count, 0 AS status_error_count)
        FROM ({body_of("agg_1_totals", "contents creators metrics lived")})"""),
    as_texts("recent_contents", "position", columns_of(RECENT_COLUMNS), body_of("srt_1_recent_contents", "details")),
    as_texts("platform_distribution", "position", columns_of("platform, content_count, view_count"),
        f"SELECT *, row_number() OVER (ORDER BY content_count DESC, view_count DESC, platform) AS position FROM ({ROLLUP})"),
    as_texts("sync_distribution", "position", columns_of("sync_status, content_count"),
        "SELECT sync_status, count(*) AS content_count, row_number() OVER (ORDER BY count(*) DESC, sync_status) AS position "
        "FROM metrics GROUP BY 1"),
]))

ORACLE["job_1_canonical_url"] = f"""
    WITH texts AS (
        SELECT page_id AS id, CASE page_id % 7
            WHEN 1 THEN concat('看看 ', url, '。 谢谢') WHEN 2 THEN upper(url)
            WHEN 3 THEN regexp_replace(url, '^https?://', '') WHEN 4 THEN concat(url, '/;p=1?q=2')
            WHEN 5 THEN CASE WHEN page_id % 2 = 0 THEN concat('　', url, '//　')
                ELSE replace(url, '.example.', '？q.example.') END WHEN 6 THEN concat('(x)', chr(10), url, ',')
            ELSE url END AS raw_url FROM pages),
    links AS (SELECT *, {LINK} AS link FROM texts)
    SELECT id, raw_url, CASE WHEN url_error IS NULL THEN {CANONICAL} END AS canonical_url, url_error
    FROM (SELECT *, CASE WHEN regexp_matches(link, '^[A-Za-z]+://[^/?#]*？') THEN 'url_invalid' END AS url_error
        FROM links)"""
ORACLE["job_2_content_id"] = f"""
    WITH made AS (
        SELECT page_id AS id, url AS raw_url, page_id % 8 AS k,
            concat('x', regexp_extract(url, '/([0-9]+)', 1)) AS slug FROM pages),
    own AS (SELECT *, {LINK} AS link FROM made),
    pages_own AS (SELECT *, {CANONICAL} AS canonical_url FROM own)
    SELECT id, CASE k
            WHEN 0 THEN concat('explore/', slug)
            WHEN 1 THEN concat('https://www.xiaohongshu.com/discovery/item/', slug)
            WHEN 2 THEN concat('https://bilibili.com/video/', slug)
            WHEN 3 THEN concat('https://b23.tv/a/BV', slug)
            WHEN 4 THEN concat('https://www.douyin.com/user/note/', slug)
            WHEN 5 THEN concat('https://weibo.cn/u/', slug)
            WHEN 6 THEN concat('https://weibo.com/', slug) ELSE canonical_url END AS canonical_url,
        CASE WHEN k = 1 THEN 'item' WHEN k IN (0, 2, 4, 5) THEN slug
            WHEN k = 3 THEN concat('BV', slug) ELSE '' END AS platform_content_id
    FROM pages_own
    UNION ALL
    SELECT id, canonical_url,
        CASE WHEN canonical_url LIKE '%example.net/%' THEN
                regexp_extract(canonical_url, '/(en|fr|de|es)/([^/]*)', 2)
            WHEN canonical_url LIKE '%example.com/%' THEN regexp_extract(canonical_url, '[^/]*$')
            ELSE '' END
    FROM pages_own"""


def greedy(rows):
    """Accept rows in id order unless an earlier accepted row holds one of their keys."""
    return f"""
    WITH RECURSIVE rows AS ({rows}),
    numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM rows),
    entered AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, false AS accepted,
            CAST([] AS VARCHAR[]) AS seen
        UNION ALL
        SELECT r.n, r.id, NOT list_has_any(e.seen, r.keys),
            CASE WHEN list_has_any(e.seen, r.keys) THEN e.seen ELSE list_concat(e.seen, r.keys) END
        FROM entered e JOIN numbered r ON r.n = e.n + 1)
    SELECT r.id, r.content_url, e.accepted FROM entered e JOIN rows r ON r.id = e.id"""


ORACLE["job_3_identity_dedup"] = greedy(f"""
    SELECT id, content_url, [concat('u', content_url), concat('c', canonical_url)] AS keys
    FROM (SELECT *, {CANONICAL} AS canonical_url FROM (SELECT *, {LINK} AS link
        FROM (SELECT page_id AS id, url AS content_url, url AS raw_url FROM pages)))""")
ORACLE["job_3_identity_chains"] = greedy(f"""
    SELECT id, content_url,
        [concat('u', content_url), concat('p', platform, '/', platform_content_id)] AS keys
    FROM ({VIEWS['entangled']})""")
ORACLE["job_4_uniqueness_audit"] = with_views("part_creators dated entangled", """
    SELECT 'creator_name_platform' AS rule, name AS key_1, platform AS key_2, count(*) AS row_count,
        min(id) AS first_id, max(id) AS last_id FROM part_creators GROUP BY 1, 2, 3 HAVING count(*) > 1
    UNION ALL
    SELECT 'project_code', project_code, '', count(*), min(id), max(id)
    FROM dated WHERE project_code <> '' GROUP BY 2 HAVING count(*) > 1
    UNION ALL
    SELECT 'content_url', content_url, '', count(*), min(id), max(id)
    FROM entangled GROUP BY 2 HAVING count(*) > 1
    UNION ALL
    SELECT 'platform_content_id', platform, platform_content_id, count(*), min(id), max(id)
    FROM entangled WHERE platform_content_id <> '' GROUP BY 2, 3 HAVING count(*) > 1
    UNION ALL
    SELECT 'metrics_content_id', CAST(l_orderkey AS VARCHAR), '', count(*), min(l_orderkey), max(l_orderkey)
    FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")

# The records are made from customer rows so that row k % 18 breaks one known rule.
CREATOR_CASES = """
    SELECT c_custkey AS seq, c_custkey % 18 AS k, c_name, c_nationkey,
        CASE WHEN c_custkey % 900 = 0 THEN 'size' WHEN c_custkey % 18 = 16 THEN 'bad_json'
            WHEN c_custkey % 18 = 17 THEN 'not_an_object' END AS refused
    FROM customer"""
ORACLE["src_2_json_ingest"] = f"""
    SELECT seq,
        CASE WHEN refused IN ('size', 'not_an_object') OR k IN (1, 2) THEN ''
            WHEN k = 11 THEN concat('dup', c_nationkey) ELSE c_name END AS name,
        CASE WHEN refused IN ('size', 'not_an_object', 'bad_json') OR k IN (6, 13, 14) THEN NULL WHEN k = 7 THEN -1
            WHEN k = 12 THEN 3 ELSE seq END AS followers_count,
        coalesce(refused, '') AS reason
    FROM ({CREATOR_CASES})""".replace("refused IN ('size', 'not_an_object') OR", "refused IS NOT NULL OR")
ORACLE["job_5_validate_creators"] = f"""
    WITH cases AS ({CREATOR_CASES}),
    named AS (
        SELECT seq, k, refused,
            CASE WHEN refused IS NOT NULL OR k IN (1, 2) THEN ''
                WHEN k = 11 THEN concat('dup', c_nationkey) ELSE c_name END AS name,
            CASE WHEN refused IS NOT NULL THEN NULL
                WHEN k IN (6, 14) THEN 0 WHEN k = 7 THEN -1 WHEN k = 12 THEN 3 ELSE seq END AS followers_count,
            coalesce(refused, CASE k WHEN 1 THEN 'category_unknown' WHEN 2 THEN 'name_empty'
                WHEN 3 THEN 'platform_empty' WHEN 4 THEN 'platform_unknown' WHEN 5 THEN 'status_unknown'
                WHEN 6 THEN 'followers_not_a_number' WHEN 7 THEN 'followers_negative'
                WHEN 8 THEN 'profile_url_domain' WHEN 9 THEN 'phone_invalid'
                WHEN 10 THEN 'email_invalid' END) AS reason
        FROM cases)
    SELECT seq, name,
        CASE WHEN refused IS NOT NULL THEN '' WHEN k = 1 THEN NULL ELSE '美食、旅游' END AS category,
        coalesce(followers_count, 0) AS followers_count,
        CASE WHEN refused IS NOT NULL THEN '' WHEN k <> 9 THEN '13800138000' END AS phone,
        CASE WHEN refused IS NOT NULL THEN '' WHEN k <> 10 THEN 'a@b.co' END AS email,
        CASE WHEN reason IS NOT NULL THEN reason
            WHEN name IN (SELECT CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE concat('stored ', c_name) END FROM customer)
                OR seq > min(seq) FILTER (reason IS NULL) OVER (PARTITION BY name)
            THEN 'duplicate_creator' END AS reason
    FROM named"""
ORACLE["job_5_validate_projects"] = with_views("dated projects", f"""
    , given AS (
        SELECT id AS seq, project_code, start_day, end_day,
            CASE WHEN id % 13 = 0 THEN 'name_empty' WHEN id % 17 = 0 THEN 'status_unknown'
                WHEN id % 5 = 0 THEN NULL WHEN id % 19 = 0 THEN 'start_date_invalid'
                WHEN id % 23 = 0 THEN 'end_date_invalid'
                WHEN end_day < start_day THEN 'end_before_start' END AS reason
        FROM dated)
    SELECT seq, project_code,
        CASE WHEN seq % 17 <> 0 AND seq % 5 = 0 THEN '已归档'
            WHEN seq % 19 = 0 OR seq % 23 = 0 OR end_day < start_day THEN NULL
            WHEN {AS_OF} < start_day THEN '未开始' WHEN {AS_OF} > end_day THEN '已结束'
            ELSE '进行中' END AS status,
        CASE WHEN reason IS NOT NULL THEN reason
            WHEN project_code <> '' AND (project_code IN (SELECT project_code FROM projects)
                OR seq > min(seq) FILTER (reason IS NULL) OVER (PARTITION BY project_code))
            THEN 'duplicate_project_code' END AS reason
    FROM given""").replace("\n\n    , given", ", given")
ORACLE["job_5_validate_contents"] = """
    WITH given AS (
        SELECT o_orderkey AS k, o_custkey + 1 AS customer,
            CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 400 ELSE o_orderkey END AS slug
        FROM orders),
    parsed AS (
        SELECT *, CASE WHEN k % 31 = 0 OR k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 999999999
                ELSE customer END AS influencer_id
        FROM given),
    known AS (SELECT *, influencer_id IN (SELECT c_custkey FROM customer) AS found FROM parsed),
    ruled AS (
        SELECT *, CASE WHEN k % 31 <> 0 AND (k % 37 = 0 OR influencer_id <= 0) THEN 'creator_id_invalid'
            WHEN k % 43 = 0 THEN 'project_id_invalid' WHEN k % 29 = 0 THEN 'title_empty'
            WHEN k % 31 = 0 THEN 'creator_missing' WHEN k % 53 = 0 THEN 'published_at_empty'
            WHEN k % 59 = 0 THEN 'status_unknown' WHEN k % 61 = 0 THEN 'content_type_unknown'
            WHEN NOT coalesce(found, false) THEN 'creator_not_found'
            WHEN k % 47 = 0 THEN 'project_not_found'
            WHEN k % 67 = 0 THEN 'view_count_not_a_number'
            WHEN k % 71 = 0 THEN 'share_count_negative' END AS reason
        FROM known)
    SELECT k AS seq, influencer_id, concat('https://www.douyin.com/video/', slug) AS canonical_url,
        CAST(slug AS VARCHAR) AS platform_content_id,
        CASE WHEN k % 67 = 0 THEN 0 ELSE k END AS view_count,
        CASE WHEN k % 71 = 0 THEN -1 ELSE 12 END AS share_count,
        CASE WHEN reason IS NOT NULL THEN reason
            WHEN k > min(k) FILTER (reason IS NULL) OVER (PARTITION BY slug) THEN 'duplicate_content' END AS reason
    FROM ruled"""

# One update after the other: a creator's own name is wanted by its row only, so only the
# other names need a walk. ``held`` has who holds which of them at the time.
ORACLE["job_5_update_creators"] = f"""
    WITH RECURSIVE entered AS ({ORACLE['job_5_validate_creators']}),
    aimed AS (
        SELECT seq, name, CASE WHEN reason = 'duplicate_creator' THEN NULL ELSE reason END AS reason,
            CASE WHEN seq % 5 = 0 THEN seq + 1 WHEN seq % 7 = 0 THEN -seq - 1 ELSE seq END AS id
        FROM entered),
    valid AS (
        SELECT row_number() OVER (ORDER BY seq) AS turn, seq, id, name FROM aimed
        WHERE reason IS NULL AND id IN (SELECT c_custkey FROM customer)),
    claimed AS (SELECT name FROM valid GROUP BY name HAVING min(id) <> max(id)
        UNION SELECT name FROM valid JOIN customer ON c_name = name WHERE c_custkey <> id),
    start AS (SELECT c_custkey AS row, c_name AS name FROM customer WHERE c_name IN (SELECT name FROM claimed)),
    walk(turn, held, refused) AS (
        SELECT 0::BIGINT, coalesce(list(struct_pack(row := row, name := name)), []), false FROM start
        UNION ALL
        SELECT v.turn, CASE WHEN taken THEN held
                WHEN v.name IN (SELECT name FROM claimed)
                THEN list_append(list_filter(held, lambda h: h.row <> v.id), struct_pack(row := v.id, name := v.name))
                ELSE list_filter(held, lambda h: h.row <> v.id) END, taken
        FROM (SELECT w.held, u.*, len(list_filter(w.held, lambda h: h.name = u.name AND h.row <> u.id)) > 0 AS taken
            FROM walk w JOIN valid u ON u.turn = w.turn + 1) v)
    SELECT seq, id, name, CASE WHEN reason IS NOT NULL THEN reason
            WHEN id NOT IN (SELECT c_custkey FROM customer) THEN 'not_found'
            WHEN seq IN (SELECT seq FROM valid JOIN walk USING (turn) WHERE refused) THEN 'duplicate_creator' END AS reason
    FROM aimed"""
ORACLE["job_5_update_projects"] = f"""
    WITH entered AS ({ORACLE['job_5_validate_projects']}),
    codes AS (SELECT o_orderkey AS id, concat('P', o_orderkey % 1000) AS code FROM orders WHERE o_orderkey % 10 <> 0),
    held AS (SELECT code, min(id) AS first_id, max(id) AS last_id FROM codes GROUP BY code),
    aimed AS (
        SELECT seq, project_code, CASE WHEN seq % 3 = 0 THEN -seq - 1 ELSE seq END AS id,
            CASE WHEN reason = 'duplicate_project_code' THEN NULL ELSE reason END AS reason
        FROM entered)
    SELECT seq, id, project_code, CASE WHEN reason IS NOT NULL THEN reason
            WHEN id < 0 THEN 'not_found'
            WHEN first_id <> id OR last_id <> id THEN 'duplicate_project_code' END AS reason
    FROM aimed LEFT JOIN held ON code = project_code"""
ORACLE["job_5_update_contents"] = f"""
    WITH entered AS ({ORACLE['job_5_validate_contents']})
    SELECT seq, CASE WHEN seq % 13 = 0 THEN -1 ELSE seq END AS id, canonical_url,
        CASE WHEN seq % 13 = 0 THEN 'not_found'
            WHEN reason IS NOT NULL AND reason <> 'duplicate_content' THEN reason
            WHEN CAST(platform_content_id AS BIGINT) <> seq THEN 'duplicate_content' END AS reason
    FROM entered"""

ORACLE["job_6_contacts"] = """
    SELECT c_custkey AS id,
        CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('138', digits) WHEN 2 THEN concat('139', digits)
            WHEN 3 THEN concat('177', digits) END AS phone,
        CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('user', digits, '@example.com')
            WHEN 4 THEN concat('u@', digits, '.x.org') END AS email,
        CASE WHEN reason IS NULL THEN concat(host, c_custkey) END AS profile_url,
        CASE WHEN c_custkey % 6 IN (4, 5) THEN 'phone_invalid' END AS phone_reason,
        CASE WHEN c_custkey % 5 IN (2, 3) THEN 'email_invalid' END AS email_reason,
        reason AS profile_url_reason
    FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS digits,
            CASE c_custkey % 7 WHEN 0 THEN 'HTTPS://Space.Bilibili.com/' WHEN 1 THEN 'http://bilibili.com:80/'
                WHEN 6 THEN 'https://b23.tv?u=' WHEN 3 THEN 'https://notbilibili.com/' END AS host,
            CASE WHEN c_custkey % 7 = 5 THEN 'profile_url_whitespace'
                WHEN c_custkey % 7 IN (2, 4) THEN 'profile_url_scheme'
                WHEN c_custkey % 4 IN (0, 1) THEN NULL
                WHEN c_custkey % 7 IN (1, 3) THEN 'profile_url_domain' END AS reason
        FROM customer)"""
ORACLE["job_6_contact_counts"] = f"""
    WITH rows AS ({ORACLE['job_6_contacts']})
    SELECT 'phone' AS contact, count(*) FILTER (phone = '') AS blank_count,
        count(*) FILTER (phone <> '') AS clean_count, count(phone_reason) AS refused_count FROM rows
    UNION ALL SELECT 'email', count(*) FILTER (email = ''), count(*) FILTER (email <> ''),
        count(email_reason) FROM rows
    UNION ALL SELECT 'profile_url', 0, count(profile_url), count(profile_url_reason) FROM rows"""
ORACLE["job_7_tags"] = """
    SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN '科技、音乐' WHEN 2 THEN ''
            WHEN 3 THEN '美妆、时尚、汽车' WHEN 4 THEN '美食' END AS category,
        CASE WHEN p_partkey % 5 = 0 THEN p_type END AS unknown_tag
    FROM part"""
ORACLE["job_8_project_status"] = with_views("lived", "SELECT id, status, status_error FROM lived")
ORACLE["job_9_page_metrics"] = """
    SELECT page_id,
        CASE page_id % 9 WHEN 0 THEN page_id * 10000 + 5000 WHEN 1 THEN page_id
            WHEN 2 THEN page_id * 1000 WHEN 5 THEN page_id WHEN 6 THEN page_id END AS like_count,
        CASE page_id % 9 WHEN 0 THEN page_id WHEN 2 THEN 12 END AS comment_count,
        CASE page_id % 9 WHEN 1 THEN CAST(concat('1', page_id) AS BIGINT) WHEN 3 THEN page_id END AS collect_count,
        CASE WHEN page_id % 9 = 8 THEN 'unsupported' WHEN page_id % 9 = 4 THEN 'challenge'
            WHEN page_id % 9 = 7 THEN 'no_metrics' ELSE 'ok' END AS outcome
    FROM pages"""
ORACLE["job_9_page_labels"] = f"""
    SELECT 'pages' AS source, page_id AS id,
        CAST(coalesce(nullif(regexp_extract(replace(first, ',', ''), '[0-9]+'), ''),
            nullif(regexp_extract(replace(before, ',', ''), '[0-9]+'), '')) AS BIGINT) AS like_count,
        CASE WHEN regexp_matches(first, '[0-9]') OR regexp_matches(before, '[0-9]')
            THEN 'ok' ELSE 'no_metrics' END AS outcome
    FROM (SELECT page_id, regexp_extract(compact, 'ad[:：]?([0-9,.]+)', 1) AS first,
            regexp_extract(compact, '([0-9,.]+)ad', 1) AS before
        FROM (SELECT page_id, regexp_replace(html, '{SPACE}+', '', 'g') AS compact FROM pages))
    UNION ALL
    SELECT 'events', event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT), 'ok' FROM events"""

STATE = """
    SELECT content_id,
        coalesce(arg_max(amount * 10, seq) FILTER (entered), 0) AS view_count,
        coalesce(arg_max(likes, seq) FILTER (entered OR (kind = 'ok' AND seq % 3 <> 0)), 0) AS like_count,
        coalesce(arg_max(comments, seq) FILTER (entered OR (kind = 'ok' AND seq % 4 <> 0)), 0) AS comment_count,
        coalesce(arg_max(collects, seq) FILTER (entered OR (kind = 'ok' AND seq % 5 <> 0)), 0) AS collect_count,
        coalesce(arg_max(amount + 3, seq) FILTER (entered), 0) AS share_count,
        arg_max(CASE WHEN kind IN ('ok', 'fail') THEN '网页解析' WHEN event_type = 'purchase' THEN '导入'
            ELSE '手动' END, seq) AS data_source,
        coalesce(arg_max(CASE kind WHEN 'ok' THEN '同步成功' WHEN 'fail' THEN '同步失败' ELSE '待同步' END, seq)
            FILTER (kind <> 'edit'), '待同步') AS sync_status,
        coalesce(arg_max(event_time, seq) FILTER (kind IN ('ok', 'fail')), '') AS last_sync_at,
        '' AS next_sync_at,
        coalesce(arg_max(CASE WHEN kind = 'ok' THEN '' WHEN seq % 2 = 0 THEN 'timeout' ELSE '同步失败' END, seq)
            FILTER (kind IN ('ok', 'fail')), '') AS failed_reason,
        arg_max(event_time, seq) AS updated_at
    FROM (SELECT *, kind IN ('create', 'edit') AS entered,
            CASE WHEN seq % 3 = 0 THEN 0 ELSE amount END AS likes,
            CASE WHEN seq % 4 = 0 THEN 0 ELSE amount + 1 END AS comments,
            CASE WHEN seq % 5 = 0 THEN 0 ELSE amount + 2 END AS collects
        FROM metric_events)
    GROUP BY content_id"""
for key in ("snk_2_metric_upsert", "job_10_metric_state", "str_1_metric_stream"):
    ORACLE[key] = with_views("metric_events", STATE)
ORACLE["snk_3_sync_log_append"] = with_views("metric_events", """
    SELECT content_id, '网页解析' AS source, CASE kind WHEN 'ok' THEN '成功' ELSE '失败' END AS status,
        event_time AS started_at, event_time AS finished_at,
        CASE WHEN kind = 'fail' THEN '' ELSE concat('{', concat_ws(', ',
            CASE WHEN seq % 3 <> 0 THEN concat('"like_count": ', amount) END,
            CASE WHEN seq % 4 <> 0 THEN concat('"comment_count": ', amount + 1) END,
            CASE WHEN seq % 5 <> 0 THEN concat('"collect_count": ', amount + 2) END), '}') END AS raw_summary,
        CASE WHEN kind = 'ok' THEN '' WHEN seq % 2 = 0 THEN 'timeout' ELSE '同步失败' END AS error_message
    FROM metric_events WHERE kind IN ('ok', 'fail')""")

ORACLE["src_1_table_scan"] = with_views("creators projects contents metrics metric_events", " UNION ALL ".join([
    as_texts("creators", "id", columns_of(CREATOR_COLUMNS), "SELECT * FROM creators"),
    as_texts("projects", "id", columns_of(PROJECT_COLUMNS), """
        SELECT *, '进行中' AS status, '' AS owner, '' AS start_date, '' AS end_date, '' AS description,
            '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at FROM projects"""),
    as_texts("contents", "id", columns_of(CONTENT_COLUMNS), "SELECT * FROM contents"),
    as_texts("content_metrics", "content_id", columns_of(METRIC_COLUMNS), """
        SELECT *, '手动' AS data_source, '' AS last_sync_at, '' AS next_sync_at, '' AS failed_reason, '' AS updated_at
        FROM metrics"""),
    as_texts("sync_logs", "content_id", columns_of(LOG_COLUMNS), body_of("snk_3_sync_log_append", "metric_events")),
]))

ORACLE["job_9_page_sync"] = with_views("metric_events", f"""
    , state AS ({STATE}),
    read AS ({ORACLE['job_9_page_metrics']}),
    linked AS (
        SELECT *, CASE WHEN page_id % 5 = 3 AND page_id % 9 <> 8 THEN page_id - 1 ELSE page_id END AS link FROM read),
    latest AS (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id DESC) = 1),
    synced AS (
        SELECT c.page_id AS content_id, l.like_count, l.comment_count, l.collect_count,
            CASE WHEN c.page_id % 9 = 8 THEN 'unsupported' WHEN l.link IS NULL THEN 'no_page' ELSE l.outcome END AS outcome
        FROM pages c LEFT JOIN latest l ON l.link = c.page_id AND c.page_id % 2 = 0
        WHERE c.page_id % 10 <> 7)
    SELECT content_id, coalesce(s.view_count, 0) AS view_count,
        coalesce(CASE WHEN outcome = 'ok' THEN y.like_count END, s.like_count, 0) AS like_count,
        CASE WHEN outcome IS NULL THEN s.data_source ELSE '网页解析' END AS data_source,
        CASE WHEN outcome IS NULL THEN s.sync_status WHEN outcome = 'ok' THEN '同步成功' ELSE '同步失败' END AS sync_status,
        CASE WHEN outcome IS NULL THEN s.last_sync_at ELSE '2024-06-01 00:00:00' END AS last_sync_at,
        CASE WHEN outcome IS NULL THEN s.failed_reason
            WHEN outcome = 'ok' THEN '' WHEN outcome = 'no_page' THEN '同步失败'
            WHEN outcome = 'challenge' THEN '页面可能触发验证或风控，暂时无法自动抓取'
            WHEN outcome = 'no_metrics' THEN '没有从页面中识别到点赞、评论或收藏数据'
            ELSE '当前第一版只支持小红书链接自动同步' END AS failed_reason,
        CASE WHEN outcome = 'ok' THEN '成功' WHEN outcome IS NOT NULL THEN '失败' END AS log_status,
        CASE WHEN outcome = 'ok' THEN concat('{{', concat_ws(', ', '"like_count": ' || y.like_count,
                '"comment_count": ' || y.comment_count, '"collect_count": ' || y.collect_count), '}}')
            WHEN outcome IS NOT NULL THEN '' END AS raw_summary
    FROM state s FULL JOIN synced y USING (content_id)""").replace("\n\n    , state", ", state")

ORACLE["job_11_migrate_metrics"] = with_views("metrics", """
    SELECT *, '手动' AS data_source, '' AS last_sync_at, '' AS next_sync_at, '' AS failed_reason, '' AS updated_at
    FROM metrics""")
ORACLE["job_11_migrate_creators"] = """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS platform, '' AS account_id, '' AS profile_url,
        '' AS category,
        CASE WHEN c_custkey % 2 = 1 THEN c_custkey WHEN c_custkey % 3 <> 0 THEN c_custkey * 10 ELSE 0 END
            AS followers_count,
        '' AS wechat, '' AS phone, '' AS email, '' AS other_contact, '' AS owner,
        CASE WHEN c_custkey % 6 = 4 THEN '停用' ELSE '正常' END AS status, '' AS remark,
        CASE WHEN c_custkey % 4 <> 0 THEN '2023-05-05 10:00:00' END AS created_at,
        CASE WHEN c_custkey % 5 = 1 THEN '2023-06-06 10:00:00'
            WHEN c_custkey % 4 <> 0 THEN '2023-05-05 10:00:00' ELSE '2024-06-01 00:00:00' END AS updated_at
    FROM customer"""
ORACLE["job_11_mixed_extracts"] = """
    WITH aged AS (
        SELECT *, c_custkey // 7 % 3 AS age,
            CASE WHEN c_custkey % 4 <> 0 THEN '2023-05-05 10:00:00' END AS made,
            CASE WHEN c_custkey % 3 <> 0 AND c_custkey // 7 % 3 < 2 THEN c_custkey * 10 END AS followers,
            CASE WHEN c_custkey // 7 % 3 = 0 OR c_custkey % 2 = 0 THEN 0 ELSE c_custkey END AS given
        FROM customer)
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS platform, '' AS account_id, '' AS profile_url,
        '' AS category, CASE WHEN given = 0 THEN coalesce(followers, 0) ELSE given END AS followers_count,
        '' AS wechat, '' AS phone, '' AS email, '' AS other_contact, '' AS owner,
        CASE WHEN c_custkey % 6 = 4 THEN '停用' ELSE '正常' END AS status, '' AS remark, made AS created_at,
        CASE WHEN age = 2 AND c_custkey % 5 = 1 THEN '2023-06-06 10:00:00'
            ELSE coalesce(made, '2024-06-01 00:00:00') END AS updated_at
    FROM aged"""
ORACLE["job_11_migrate_projects"] = with_views("dated", """
    SELECT id, name, '' AS project_code, status, owner, start_date, end_date, '' AS description,
        created_at, updated_at FROM dated""")
ORACLE["job_11_migrate_contents"] = f"""
    WITH made AS (
        SELECT page_id AS id, url AS raw_url, page_id % 8 AS k,
            concat('x', regexp_extract(url, '/([0-9]+)', 1)) AS slug FROM pages),
    own AS (SELECT *, {LINK} AS link FROM made)
    SELECT id, CASE k
            WHEN 0 THEN concat('explore/', slug)
            WHEN 1 THEN concat('https://www.xiaohongshu.com/discovery/item/', slug)
            WHEN 2 THEN concat('https://m.bilibili.com/video/', slug, '/?p=1')
            WHEN 3 THEN concat('https://b23.tv/a/BV', slug)
            WHEN 4 THEN concat('https://www.douyin.com/user/note/', slug)
            WHEN 5 THEN concat('https://m.weibo.cn/u/', slug, '/')
            WHEN 6 THEN concat('https://weibo.com/', slug) ELSE raw_url END AS content_url,
        CASE WHEN id % 3 = 0 THEN 'kept' ELSE CASE k
            WHEN 0 THEN concat('explore/', slug)
            WHEN 1 THEN concat('https://www.xiaohongshu.com/discovery/item/', slug)
            WHEN 2 THEN concat('https://bilibili.com/video/', slug)
            WHEN 3 THEN concat('https://b23.tv/a/BV', slug)
            WHEN 4 THEN concat('https://www.douyin.com/user/note/', slug)
            WHEN 5 THEN concat('https://weibo.cn/u/', slug)
            WHEN 6 THEN concat('https://weibo.com/', slug) ELSE {CANONICAL} END END AS canonical_url,
        CASE WHEN id % 3 = 1 THEN 'kept' WHEN k = 1 THEN 'item' WHEN k IN (0, 2, 4, 5) THEN slug
            WHEN k = 3 THEN concat('BV', slug) ELSE '' END AS platform_content_id,
        '正常' AS status, '' AS remark
    FROM own"""

ORACLE["job_12_creator_report"] = with_views("creators", """
    SELECT id, upper(name[1]) AS initial, concat(name, ' / ', account_id) AS label, name,
        account_id AS account, platform,
        CASE id % 4 WHEN 0 THEN '-' WHEN 3 THEN '科技' ELSE '美食' END AS first_tag,
        CASE id % 4 WHEN 2 THEN '+1' WHEN 3 THEN '+2' ELSE '' END AS more_tags,
        replace(category, ',', '、') AS all_tags, format('{:,}', followers_count) AS followers, owner,
        CASE WHEN wechat <> '' THEN wechat WHEN phone <> '' THEN phone WHEN email <> '' THEN email
            ELSE '-' END AS contact,
        status, replace(updated_at, 'T', ' ')[:16] AS updated
    FROM creators""")
ORACLE["job_12_project_report"] = with_views("lived", """
    SELECT id, 'P' AS initial,
        CASE WHEN length(name) > 10 THEN concat(name[:10], '...') ELSE name END AS name,
        CASE WHEN description = '' THEN '未填写项目说明'
            WHEN length(description) > 12 THEN concat(description[:12], '...') ELSE description END AS description,
        CASE WHEN project_code = '' THEN '-' ELSE project_code END AS project_code, status, owner,
        start_date, CASE WHEN end_date = '' THEN '-' ELSE end_date END AS end_date, updated_at AS updated
    FROM lived""")
ORACLE["job_12_content_report"] = with_views("details", """
    SELECT id, 'O' AS initial, CASE WHEN length(title) > 16 THEN concat(title[:16], '...') ELSE title END AS title,
        content_type, influencer_name AS creator, platform,
        CASE WHEN project_name = '' THEN '-' ELSE project_name END AS project, published_at,
        format('{:,}', view_count) AS views, format('{:,}', interaction_count) AS interactions,
        coalesce(sync_status, '待同步') AS sync_status, updated_at AS updated
    FROM details""")

"""Table layouts and the fixed values the jobs depend on.

Missing text is ``''`` and a missing project is NULL, in every table.
"""

# Names and order of the columns of each table.
CREATORS = {
    "id": "bigint",
    "name": "string",
    "platform": "string",
    "account_id": "string",
    "profile_url": "string",
    "category": "string",
    "followers_count": "bigint",
    "wechat": "string",
    "phone": "string",
    "email": "string",
    "other_contact": "string",
    "owner": "string",
    "status": "string",
    "remark": "string",
    "created_at": "string",
    "updated_at": "string",
}

PROJECTS = {
    "id": "bigint",
    "name": "string",
    "project_code": "string",
    "status": "string",
    "owner": "string",
    "start_date": "string",
    "end_date": "string",
    "description": "string",
    "created_at": "string",
    "updated_at": "string",
}

CONTENTS = {
    "id": "bigint",
    "title": "string",
    "influencer_id": "bigint",
    "project_id": "bigint",
    "platform": "string",
    "content_url": "string",
    "canonical_url": "string",
    "platform_content_id": "string",
    "published_at": "string",
    "content_type": "string",
    "owner": "string",
    "status": "string",
    "remark": "string",
    "created_at": "string",
    "updated_at": "string",
}

CONTENT_METRICS = {
    "content_id": "bigint",
    "view_count": "bigint",
    "like_count": "bigint",
    "comment_count": "bigint",
    "collect_count": "bigint",
    "share_count": "bigint",
    "data_source": "string",
    "sync_status": "string",
    "last_sync_at": "string",
    "next_sync_at": "string",
    "failed_reason": "string",
    "updated_at": "string",
}

SYNC_LOGS = {
    "content_id": "bigint",
    "source": "string",
    "status": "string",
    "started_at": "string",
    "finished_at": "string",
    "raw_summary": "string",
    "error_message": "string",
}

PAGES = {"page_id": "bigint", "url": "string", "html": "string"}

TABLES = {
    "creators": CREATORS,
    "projects": PROJECTS,
    "contents": CONTENTS,
    "content_metrics": CONTENT_METRICS,
    "sync_logs": SYNC_LOGS,
    "pages": PAGES,
}

# What a missing column of an older extract is filled with, '' or 0 otherwise.
DEFAULTS = {
    "creators": {"status": "正常"},
    "projects": {"status": "进行中"},
    "contents": {"status": "正常"},
    "content_metrics": {"data_source": "手动", "sync_status": "待同步"},
}

COUNTERS = ("view_count", "like_count", "comment_count", "collect_count", "share_count")
INTERACTIONS = ("like_count", "comment_count", "collect_count", "share_count")

# Enumerations.
PLATFORMS = ("小红书", "抖音", "B站", "视频号", "微博", "快手", "其他")
UNRESTRICTED_PLATFORM = "其他"
CATEGORY_TAGS = (
    "影视娱乐", "音乐", "生活", "人文艺术", "摄影", "旅游", "搞笑趣闻", "情感",
    "教育", "母婴育儿", "财经", "游戏动漫", "健康", "运动", "科学科普", "科技",
    "互联网", "职场管理", "美食", "时尚", "美妆", "萌宠", "汽车",
)
TAG_JOINER = "、"
CREATOR_ACTIVE = "正常"
CREATOR_STATUSES = ("正常", "停用")
LEGACY_CREATOR_STATUSES = ("待建联", "已建联", "合作中", "已完成")
CONTENT_NORMAL = "正常"
CONTENT_STATUSES = ("正常", "作废")
CONTENT_TYPE_DEFAULT = "视频"
CONTENT_TYPES = ("视频", "图文", "其他")
PROJECT_AUTO = "自动判断"
PROJECT_PENDING = "未开始"
PROJECT_RUNNING = "进行中"
PROJECT_ENDED = "已结束"
PROJECT_ARCHIVED = "已归档"
PROJECT_ARCHIVED_INPUTS = ("归档", "已归档")
PROJECT_STATUS_INPUTS = ("自动判断", "未开始", "进行中", "已结束", "归档", "已归档")
SYNC_PENDING = "待同步"
SYNC_OK = "同步成功"
SYNC_FAILED = "同步失败"
LOG_OK = "成功"
LOG_FAILED = "失败"
SOURCE_MANUAL = "手动"
SOURCE_PAGE = "网页解析"

# Domains a profile link may point to; the unrestricted platform has none.
PROFILE_DOMAINS = {
    "小红书": ("xiaohongshu.com", "xhslink.com"),
    "抖音": ("douyin.com", "v.douyin.com", "iesdouyin.com"),
    "B站": ("bilibili.com", "space.bilibili.com", "b23.tv"),
    "视频号": ("channels.weixin.qq.com", "weixin.qq.com"),
    "微博": ("weibo.com", "weibo.cn"),
    "快手": ("kuaishou.com", "v.kuaishou.com", "live.kuaishou.com"),
}

# Where saved pages carry their counters.
PAGE_PLATFORM = "小红书"
PAGE_HOST = "xiaohongshu.com"
PAGE_CHALLENGE_WORDS = ("验证", "小红书")
PAGE_FIELDS = {
    "like_count": ("likedCount", "likeCount", "liked_count", "like_count", "likes"),
    "comment_count": ("commentCount", "commentsCount", "comment_count", "comments"),
    "collect_count": (
        "collectedCount", "collectCount", "favoriteCount", "collect_count", "favorites",
    ),
}
PAGE_LABELS = {
    "like_count": ("点赞", "赞"),
    "comment_count": ("评论",),
    "collect_count": ("收藏",),
}
# The failure text stored for each page outcome.
PAGE_FAILURES = {
    "challenge": "页面可能触发验证或风控，暂时无法自动抓取",
    "no_metrics": "没有从页面中识别到点赞、评论或收藏数据",
    "unsupported": "当前第一版只支持小红书链接自动同步",
}

MAX_RECORD_BYTES = 100_000
RECENT_ROWS = 5


def ddl(columns):
    """DDL text of a layout, as ``DataFrameReader.schema`` takes it."""
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())

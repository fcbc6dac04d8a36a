"""Link expressions: canonical form and platform content id."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE_CLASS, strip

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
# Punctuation that clings to a link pasted into a sentence.
LINK_PUNCTUATION = "，,。)"
# Schemes whose last path segment may carry ;parameters.
PARAMETER_SCHEMES = (
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "sip", "sips", "mms", "sftp", "tel",
)
# Signs that compatibility normalization turns into one of / ? # @ : or a text
# with one; a link whose authority holds one is refused.
DOUBTFUL_SIGNS = "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠"


def first_link(text) -> Column:
    """First white-space separated part that starts with http(s)://, else the whole text.

    Most texts are a link and nothing else, which needs no search.
    """
    alone = text.rlike(r"\Ahttps?://[!-~]*\z")
    parts = F.regexp_extract_all(
        text, F.lit(f"(?:^|[{SPACE_CLASS}])(https?://[^{SPACE_CLASS}]*)"), F.lit(1)
    )
    found = F.coalesce(F.trim(F.get(parts, 0), F.lit(LINK_PUNCTUATION)), strip(text))
    return F.when(alone, F.trim(text, F.lit(LINK_PUNCTUATION))).otherwise(found)


def _without_query(text) -> Column:
    return F.substring_index(F.substring_index(text, "#", 1), "?", 1)


def _without_parameters(scheme, path) -> Column:
    """Drop ``;...`` from the last segment where the scheme knows parameters."""
    return F.when(
        path.contains(";") & F.lower(scheme).isin("", *PARAMETER_SCHEMES),
        F.regexp_replace(path, r";[^/]*$", ""),
    ).otherwise(path)


def doubtful_authority(url) -> Column:
    """The part between ``//`` and the path holds a sign that looks like a separator."""
    return F.regexp_extract(url, f"^(?:{SCHEME}:)?//([^/?#]*)", 1).rlike(f"[{DOUBTFUL_SIGNS}]")


def with_canonical_url(
    df: DataFrame, source="content_url", target="canonical_url", error=None
) -> DataFrame:
    """Scheme and host in lower case, one leading ``m.`` and the tail of the link dropped.

    ``www.``, port, user info, path case and the http/https difference stay. Text
    without scheme or host only loses its trailing slashes. The link and its head are
    columns of their own on the way, so that each regex runs once per row. ``error`` names
    a column for the reason a link is refused, whose canonical form is NULL then.
    """
    link, head = F.col("_link"), F.col("_head")
    clean = F.translate(link, "\t\r\n", "")
    scheme = F.substring_index(head, "://", 1)
    host = F.substr(head, F.length(scheme) + 4)
    path = _without_query(F.substr(clean, F.length(head) + 1))
    canonical = F.when(head == "", F.rtrim(link, F.lit("/"))).otherwise(
        F.concat(
            scheme,
            F.lit("://"),
            F.when(host.startswith("m."), F.substr(host, F.lit(3))).otherwise(host),
            F.rtrim(_without_parameters(scheme, path), F.lit("/")),
        )
    )
    # Only signs beyond ASCII are in doubt.
    doubtful = (F.octet_length(link) > F.length(link)) & link.rlike(f"[{DOUBTFUL_SIGNS}]")
    refused = F.when(doubtful & doubtful_authority(clean), "url_invalid")
    out = (
        df.withColumn("_link", first_link(F.col(source)))
        .withColumn("_head", F.lower(F.regexp_extract(clean, f"^{SCHEME}://[^/?#]+", 0)))
        .withColumn("_refused", refused)
        .withColumn(target, F.when(F.col("_refused").isNull(), canonical))
    )
    if error:
        out = out.withColumn(error, F.col("_refused"))
    return out.drop("_link", "_head", "_refused")


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(url, f"^({SCHEME}):", 1))


def url_host(url) -> Column:
    """Authority of ``url`` in lower case (port and user info included), or ``''``."""
    return F.lower(F.regexp_extract(url, f"^(?:{SCHEME}:)?//([^/?#]*)", 1))


def path_segments(url) -> Column:
    """Non-empty path segments of ``url``."""
    path = _without_query(F.regexp_replace(url, f"^(?:{SCHEME}:)?(?://[^/?#]*)?", ""))
    path = _without_parameters(url_scheme(url), path)
    return F.filter(F.split(path, "/"), lambda part: part != "")


@dataclass(frozen=True)
class ContentIdRule:
    """How one platform spells the id of a content in its links.

    The rule holds for rows of ``platform`` and for hosts containing ``host``. The id is
    the segment after the first of ``markers`` that has one, else the first segment
    starting with one of ``prefixes``, else the last of at least ``last_of`` segments.
    """

    platform: str
    host: str
    markers: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    last_of: int = 0

    def applies(self, platform, host) -> Column:
        return (platform == self.platform) | host.contains(self.host)

    def content_id(self, parts) -> Column:
        options = [
            F.get(parts, F.nullif(F.array_position(parts, marker), F.lit(0)).cast("int"))
            for marker in self.markers
        ]
        if self.prefixes:
            starts = "^(" + "|".join(self.prefixes) + ")"
            options.append(F.get(F.filter(parts, lambda part: part.rlike(starts)), 0))
        if self.last_of:
            options.append(F.when(F.size(parts) >= self.last_of, F.element_at(parts, -1)))
        return F.coalesce(*options, F.lit(""))


# Fixed values, in order of precedence. /discovery/item/{id} gives the id "item": known
# and kept; pass rules with another marker order to change it.
CONTENT_ID_RULES = (
    ContentIdRule("小红书", "xiaohongshu.com", markers=("explore", "discovery", "item")),
    ContentIdRule("B站", "bilibili.com", markers=("video",), prefixes=("BV", "av")),
    ContentIdRule("抖音", "douyin.com", markers=("video", "note")),
    ContentIdRule("微博", "weibo.com", last_of=2),
)


def with_content_id(
    df: DataFrame,
    rules=CONTENT_ID_RULES,
    platform="platform",
    canonical="canonical_url",
    target="platform_content_id",
) -> DataFrame:
    """Platform content id in a canonical link; ``''`` where no rule finds one."""
    host, parts = F.col("_host"), F.col("_parts")
    chosen = None
    for rule in rules:
        applies, value = rule.applies(F.col(platform), host), rule.content_id(parts)
        chosen = F.when(applies, value) if chosen is None else chosen.when(applies, value)
    return (
        df.withColumn("_host", url_host(F.col(canonical)))
        .withColumn("_parts", path_segments(F.col(canonical)))
        .withColumn(target, chosen.otherwise(""))
        .drop("_host", "_parts")
    )

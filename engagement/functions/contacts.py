"""Contact expressions: each gives the clean value and the reason it was refused."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PROFILE_DOMAINS, UNRESTRICTED_PLATFORM
from .links import SCHEME, doubtful_authority, url_host
from .text import PRINTABLE, SPACE_CLASS, drop_whitespace, has_whitespace, strip


def _checked(value, reason) -> Column:
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def phone(col) -> Column:
    """Mainland mobile number without spaces, dashes and country prefix."""
    text = strip(col)
    compact = F.regexp_replace(drop_whitespace(F.replace(text, F.lit("-"), F.lit(""))), r"^(\+86|0086)", "")
    bad = (text != "") & ~compact.rlike(r"^1[3-9][0-9]{9}$")
    return _checked(F.when(text == "", "").otherwise(compact), F.when(bad, "phone_invalid"))


def email(col) -> Column:
    """Lower-case address with one ``@`` and a dot after it."""
    text = F.lower(strip(col))
    part = f"[^@{SPACE_CLASS}]+"
    well = F.when(text.rlike(PRINTABLE), text.rlike(r"^[^@]+@[^@]+\.[^@]+\z"))
    bad = (text != "") & ~well.otherwise(text.rlike(rf"^{part}@{part}\.{part}\z"))
    return _checked(text, F.when(bad, "email_invalid"))


def allowed_host(host, domains) -> Column:
    """``host`` is one of ``domains`` or lies below one; the port belongs to the host."""
    return F.exists(domains, lambda domain: (host == domain) | host.endswith(F.concat(F.lit("."), domain)))


def profile_url(col, platform) -> Column:
    """http(s) link without white space, on a domain of the platform if it has any."""
    text = strip(col)
    domains = F.create_map(
        *[
            item
            for name, hosts in PROFILE_DOMAINS.items()
            for item in (F.lit(name), F.array(*map(F.lit, hosts)))
        ]
    )
    allowed = domains[platform]
    reason = (
        F.when(text == "", None)
        .when(has_whitespace(text), "profile_url_whitespace")
        .when(doubtful_authority(text), "profile_url_invalid")
        .when(~text.rlike(r"^(?i:https?)://[^/?#]"), "profile_url_scheme")
        .when(platform == UNRESTRICTED_PLATFORM, None)
        .when(allowed.isNotNull() & ~allowed_host(url_host(text), allowed), "profile_url_domain")
    )
    return _checked(text, reason.cast("string"))

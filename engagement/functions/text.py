"""Text expressions: stripping, keyword matching, whole numbers."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)
# The same characters inside a regex bracket.
SPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


# Texts of these characters hold no white space; this test is some 20 times as fast as that
# with the class above.
PRINTABLE = r"\A[!-~]*\z"


def strip(col) -> Column:
    """Trim all Unicode white space; NULL becomes ``''``."""
    return F.trim(F.coalesce(col, F.lit("")), F.lit(WHITESPACE))


def drop_whitespace(col) -> Column:
    return F.when(col.rlike(PRINTABLE), col).otherwise(F.regexp_replace(col, f"[{SPACE_CLASS}]+", ""))


def has_whitespace(col) -> Column:
    return ~col.rlike(PRINTABLE) & col.rlike(f"[{SPACE_CLASS}]")


def or_default(col, default) -> Column:
    """``default`` where ``col`` is NULL or ``''``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def fold_ascii(col) -> Column:
    """Upper-case a-z only: ``É`` and ``é`` stay different."""
    return F.translate(col, string.ascii_lowercase, string.ascii_uppercase)


def matches_keyword(keyword, *cols) -> Column | None:
    """True where any of ``cols`` contains ``keyword``; None for a blank keyword.

    ASCII letters match in either case. ``%`` and ``_`` in the keyword are wildcards
    and ``\\`` is an ordinary character.
    """
    keyword = (keyword or "").strip()
    if not keyword:
        return None
    upper = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)
    pattern = "%" + keyword.translate(upper).replace("\\", "\\\\") + "%"
    matches = [fold_ascii(F.col(c) if isinstance(c, str) else c).like(pattern) for c in cols]
    found = matches[0]
    for match in matches[1:]:
        found = found | match
    return found


def whole_number(col) -> Column:
    """Integer spelled in text (sign and single inner underscores allowed), else NULL."""
    text = strip(col)
    grouped = F.when(
        text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit(""))
    )
    return F.coalesce(col.try_cast("bigint"), grouped.try_cast("bigint"))

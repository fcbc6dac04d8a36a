"""Counter expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import INTERACTIONS


def displayed_count(col) -> Column:
    """Number shown on a page, such as ``1.2万``, ``3k+`` or ``1,234``; NULL without digits.

    The product is cut to a whole number after a double multiplication. A number beyond
    64 bits counts as unreadable.
    """
    digits = F.regexp_extract(F.translate(col, ",+", ""), r"[0-9]+(\.[0-9]+)?", 0)
    scale = (
        F.when(col.rlike("[万wW]"), 10000).when(col.rlike(r"[千kK\x{212a}]"), 1000).otherwise(1)
    )
    return (F.nullif(digits, F.lit("")).cast("double") * scale).try_cast("bigint")


def interactions(prefix="") -> Column:
    """Sum of the four reactions, each missing one counting as 0."""
    total = F.lit(0).cast("bigint")
    for name in INTERACTIONS:
        total = total + F.coalesce(F.col(prefix + name), F.lit(0))
    return total


def interactions_or_zero(prefix="") -> Column:
    """Sum of the four reactions, 0 as soon as one of them is missing."""
    first, *rest = [F.col(prefix + name) for name in INTERACTIONS]
    for col in rest:
        first = first + col
    return F.coalesce(first, F.lit(0))

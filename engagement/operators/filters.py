"""Row filters. Each returns a Column, or None where the filter is not set."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_keyword

__all__ = ["all_of", "bound", "equals", "has_tag", "in_range", "linked_to", "matches_keyword", "where"]


def all_of(*conditions) -> Column | None:
    given = [condition for condition in conditions if condition is not None]
    return reduce(lambda left, right: left & right, given) if given else None


def where(df: DataFrame, *conditions) -> DataFrame:
    condition = all_of(*conditions)
    return df if condition is None else df.filter(condition)


def equals(col, value) -> Column | None:
    value = (value or "").strip()
    return col == value if value else None


def has_tag(tags, value) -> Column | None:
    """Rows whose array ``tags`` holds the whole tag ``value``; a keyword also finds parts of one."""
    value = (value or "").strip()
    return F.array_contains(tags, value) if value else None


def bound(value, name) -> int | None:
    """A range bound given as number or text: None when blank, never negative."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number") from None
    if number < 0:
        raise ValueError(f"{name} must not be negative")
    return number


def in_range(col, low, high, name, missing_is_zero=False) -> Column | None:
    """``low <= col <= high``, each end optional.

    With ``missing_is_zero`` a NULL counts as 0. It is spelled without ``coalesce`` so
    that the comparison still reaches the parquet scan and a positive ``low`` turns an
    outer join into an inner one.
    """
    low, high = bound(low, f"{name}_min"), bound(high, f"{name}_max")
    if low is not None and high is not None and low > high:
        raise ValueError(f"{name}_min must not exceed {name}_max")
    above = below = None
    if low is not None:
        above = col >= low
        if missing_is_zero and low == 0:
            above = above | col.isNull()
    if high is not None:
        below = col <= high
        if missing_is_zero:
            below = below | col.isNull()
    return all_of(above, below)


def linked_to(col, choice) -> Column | None:
    """``"none"`` keeps rows without a link, an id keeps the rows linked to it."""
    choice = str(choice if choice is not None else "").strip()
    if not choice:
        return None
    if choice == "none":
        return col.isNull()
    try:
        return col == int(choice)
    except ValueError:
        raise ValueError("project filter must be an id or 'none'") from None

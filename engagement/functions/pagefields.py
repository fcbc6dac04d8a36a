"""Text of the counters in saved pages: quoted fields first, visible labels second."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS

SPACES = f"[{SPACE_CLASS}]*"
HAS_DIGIT = "(?s)^.*[0-9].*$"
PLAIN_NUMBER = r"[0-9]+(?:\.[0-9]+)?"
# A number beside a label, with its unit.
LABEL_NUMBER = "[0-9,.]+(?:万|千|w|W|k|K)?"


def _first_readable(page, patterns) -> Column:
    """Text in group 1 of the first pattern whose first match holds a digit, else NULL.

    The patterns are tried one after the other until one succeeds.
    """

    def attempt(found, pattern):
        first_match = F.call_function("regexp_extract", page, pattern, F.lit(1))
        return F.coalesce(found, F.get(F.regexp_extract_all(first_match, F.lit(HAS_DIGIT), F.lit(0)), 0))

    return F.aggregate(F.array(*map(F.lit, patterns)), F.lit(None).cast("string"), attempt)


def field_patterns(name) -> list[str]:
    """Spellings of a field, in order: double then single quotes, text then number."""
    return [
        rf"(?iu){quote}{name}{quote}{SPACES}:{SPACES}{value}"
        for quote in ('"', "'")
        for value in (f"{quote}([^{quote}]+){quote}", f"({PLAIN_NUMBER})")
    ]


def field_text(page, names) -> Column:
    """Text of the first field among ``names`` that has a readable value.

    One test for any of the quoted names spares the single patterns on the many pages
    that have none of them.
    """
    patterns = [pattern for name in names for pattern in field_patterns(name)]
    mentioned = page.rlike(rf"(?iu)[\"'](?:{'|'.join(names)})[\"']{SPACES}:")
    return F.when(mentioned, _first_readable(page, patterns))


def label_text(compact, labels) -> Column:
    """Number right after, else right before, the first label that has one.

    ``compact`` is the page without white space.
    """
    patterns = [
        pattern
        for label in labels
        for pattern in (f"{label}[:：]?({LABEL_NUMBER})", f"({LABEL_NUMBER}){label}")
    ]
    mentioned = F.lit(False)
    for label in labels:
        mentioned = mentioned | compact.contains(label)
    return F.when(mentioned, _first_readable(compact, patterns))

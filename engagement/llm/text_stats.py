"""Statistics of whole texts as column expressions; a null text counts as empty."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def characters(text: Column, which: str) -> Column:
    """How many of the characters in ``which`` the text has."""
    return F.length(text) - F.length(F.translate(text, which, ""))


def written_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")


def repeats(values: Column) -> Column:
    """How many elements equal an earlier one."""
    return F.size(values) - F.size(F.array_distinct(values))


def share(part: Column, of: Column) -> Column:
    return F.when(of > 0, part.cast("double") / of).otherwise(0.0)

"""Category tag expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CATEGORY_TAGS, TAG_JOINER
from .text import WHITESPACE


def tag_list(col) -> Column:
    """Trimmed non-empty tags of a joined text, repeats included."""
    parts = F.split(F.coalesce(col, F.lit("")), "[、,，]")
    trimmed = F.transform(parts, lambda part: F.trim(part, F.lit(WHITESPACE)))
    return F.filter(trimmed, lambda part: part != "")


def clean_tags(col, allowed=CATEGORY_TAGS) -> Column:
    """Struct of the tags joined again, first occurrence kept, and the first unknown tag."""
    tags = tag_list(col)
    unknown = F.get(F.filter(tags, lambda tag: ~tag.isin(*allowed)), 0)
    joined = F.array_join(F.array_distinct(tags), TAG_JOINER)
    return F.struct(
        F.when(unknown.isNull(), joined).alias("value"), unknown.alias("unknown_tag")
    )

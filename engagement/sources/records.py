"""Incoming JSON records: size guard, parsing, typed access to single fields.

A record stays one VARIANT column, because the rules depend on how a field was written:
``3.7`` is cut to 3 and ``"3.7"`` is refused, a missing field is not a ``null`` field.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, whole_number
from ..schemas import MAX_RECORD_BYTES
from ..session import cut_lineage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text per line; ``seq`` counts them from 0 by file path and position.

    The order does not depend on the sizes of files and splits. The lines are written out
    once, so that they can be counted and numbered from the same reading: a line's number
    is how many lines the splits before its own have, plus its place in its split.
    """
    read = spark.read.text(path).select(
        F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    lines = cut_lineage(read)
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
    # One row per split of the input, however many lines there are.
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    return lines.join(splits, ["file", "start"]).select(
        (F.col("before") + F.col("place") - F.col("first")).alias("seq"), "body"
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Add ``record`` (VARIANT) and ``reason`` (NULL when the text is a JSON object).

    The text is parsed as the only element of an array, so that anything after the first
    value is an error too. What follows a closing bracket is not seen that way; a text
    with such a bracket must also parse as a field of an object. ``NaN`` and ``Infinity``
    are not JSON here.

    The lines are dealt out by ``seq`` before: parsing and checking cost far more than a
    shuffle, and a few well compressed bytes of a file, one task's share, can hold most lines.
    """
    lines = lines.repartition("seq")
    size = F.octet_length("body")
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    parsed = F.when(size.between(1, MAX_RECORD_BYTES), wrapped)
    field = F.try_parse_json(F.concat(F.lit('{"v":'), F.col("body"), F.lit("}")))
    closed = F.when(F.col("body").contains("]"), field.isNotNull()).otherwise(True)
    # The text of a valid value begins with its kind.
    first = F.substring(F.regexp_extract("body", r"^[ \t\r\n]*(.)", 1), 1, 1)
    return (
        lines.withColumn("parsed", F.when(closed, parsed))
        .withColumn("record", F.try_variant_get("parsed", "$[0]", "variant"))
        .withColumn(
            "reason",
            F.when(~F.coalesce(size.between(1, MAX_RECORD_BYTES), F.lit(False)), "size")
            .when(
                F.col("parsed").isNull()
                | F.col("record").isNull()
                | F.try_variant_get("parsed", "$[1]", "variant").isNotNull(),
                "bad_json",
            )
            .when(first != "{", "not_an_object"),
        )
        .drop("parsed")
    )


def _variant(key) -> Column:
    return F.try_variant_get("record", f"$.{key}", "variant")


def read_fields(records: DataFrame, texts, numbers=()) -> DataFrame:
    """(seq, reason), the text fields cleaned, and ``key__kind``/``key__text`` per number.

    Each field is looked up once, however many rules read it. The ``id`` of the row an
    update is for is kept, too.
    """
    kept = [name for name in ("seq", "id", "reason") if name in records.columns]
    columns = [F.try_variant_get("record", f"$.{key}", "string").alias(key) for key in texts]
    for key in numbers:
        columns.append(F.schema_of_variant(_variant(key)).alias(f"{key}__kind"))
        columns.append(F.try_variant_get("record", f"$.{key}", "string").alias(f"{key}__text"))
    found = records.select(*kept, "record", *columns)
    return found.withColumns({key: text_value(key) for key in texts}).drop("record")


def text_value(key) -> Column:
    """Stripped text; missing, null, 0, false and empty containers give ``''``.

    The JSON type is asked for only where the text could be one of those.
    """
    text = F.col(key)
    doubtful = F.substring(text, 1, 1).isin("0", "-", "t", "f", "[", "{")
    unquoted = doubtful & (F.schema_of_variant(_variant(key)) != "STRING")
    empty = text.isin("false", "[]", "{}") | (F.translate(text, "0.-", "") == "")
    shown = F.when(text == "true", "True").when(~empty, text)
    return strip(F.when(unquoted, shown).otherwise(text))


def is_present(key) -> Column:
    """The record names the number field, be it with null."""
    return F.col(f"{key}__kind").isNotNull()


def is_blank(key) -> Column:
    """The number field is missing, null or ``""``."""
    kind = F.col(f"{key}__kind")
    empty = (kind == "STRING") & (F.col(f"{key}__text") == "")
    return F.coalesce((kind == "VOID") | empty, F.lit(True))


def number_value(key) -> Column:
    """Whole number of a field, NULL where there is none.

    JSON numbers are cut towards zero, JSON booleans are 1 and 0, text must spell a whole
    number.
    """
    kind, text = F.col(f"{key}__kind"), F.col(f"{key}__text")
    return (
        F.when(kind == "STRING", whole_number(text))
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("bigint"))
        .when(kind == "BIGINT", text.try_cast("bigint"))
        .when(kind.startswith("DECIMAL"), text.try_cast("decimal(38,18)").try_cast("bigint"))
        .when(kind.isin("DOUBLE", "FLOAT"), text.try_cast("double").try_cast("bigint"))
    )

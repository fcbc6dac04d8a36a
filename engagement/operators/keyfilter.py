"""A Bloom filter over the keys of a batch, to drop stored rows where they are scanned.

A batch small enough is broadcast by Spark, and then the stored table is not shuffled
anyway. A larger batch makes the join shuffle the stored table; here a bitmap of bounded
size, built by an aggregation over the batch, drops most stored rows before that.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Batches with fewer keys are left to Spark's own choice of join.
FROM_KEYS = 1 << 19
#: Bits for each key, and positions of a key.
BITS_A_KEY, POSITIONS = 10, 3
#: Bits of the largest bitmap: 8 MB. Beyond some seven million keys it lets more rows through.
MOST_BITS = 1 << 26
#: Bits of one piece of a bitmap as Spark's functions build it.
PIECE = 32768


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(POSITIONS)]


def key_filter(keys: DataFrame, key: str, n: int):
    """A test for columns: false only for values that are not among the ``n`` keys.

    The bitmap is the result of a scalar subquery: it is built on the executors, piece by
    piece, and put into the scan of whatever the test filters.
    """
    bits = PIECE
    while bits < min(MOST_BITS, n * BITS_A_KEY):
        bits *= 2
    # Spark counts bits from 1, and pieces as well.
    places = F.array(*[place + 1 for place in _positions(F.col(key), bits)])
    pieces = keys.select(F.explode(places).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("piece"))
    pieces = pieces.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    built = F.map_from_entries(F.collect_list(F.struct("piece", "bits")))
    blank = F.lit(bytes(PIECE // 8))
    whole = F.transform(F.sequence(F.lit(1), F.lit(bits // PIECE)), lambda i: F.coalesce(F.try_element_at("built", i.cast("bigint")), blank))
    bitmap = pieces.agg(built.alias("built")).select(whole.alias("bitmap")).scalar()

    def test(column: Column) -> Column:
        found = F.lit(True)
        for place in _positions(column, bits):
            piece = F.get(bitmap, F.floor(place / PIECE).cast("int"))
            byte = F.substring(piece, F.floor(place % PIECE / 8).cast("int") + 1, F.lit(1))
            found = found & (F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1)
        return found

    return test


def sieve(stored: DataFrame, column: Column, keys: DataFrame, key: str) -> DataFrame:
    """``stored`` without most of the rows whose ``column`` is not in ``keys``.

    ``keys`` is a written table, as it is counted first and read again.
    """
    n = keys.count()
    return stored.filter(key_filter(keys, key, n)(column)) if n >= FROM_KEYS else stored

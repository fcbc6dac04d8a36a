"""Vectors as short codes: each part of a vector becomes the index of a codebook entry.

Codebooks are fitted by rounds of nearest-entry assignment and integer means, in exact
integer arithmetic. Entries are looked up by pivots (LAESA, Mico, Oncina, Vidal 1994): the
distances of every part to a few fixed pivots are computed once and stored beside the
vector. In each round the distances from pivots to entries give, for each pair of part and
entry, a lower bound of their distance, the largest difference of two pivot distances.
Entries are tried in the order of their bounds, and only those whose bound does not exceed
the best distance so far are evaluated. Tasks put out sums for each codebook entry, so a
round shuffles no vectors, and only sums of a fixed number come to the driver.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, stored
from .ship import ship

#: What single precision may add to a pivot distance, as a share of it, with room to spare.
SLACK = np.float32(2e-6)
#: Entries tried one after the other before the bounds left over are tried together.
ORDERED = 2


def _limit(dim: int) -> int:
    """The largest component whose squared distances, over all parts, fit 64 bits."""
    return min(1 << 27, int((2**61 / max(1, dim)) ** 0.5) // 2)


def _integers(scale: float):
    """Usable rows: vec_id, label, dim, and the components as 32-bit integers."""

    def integers(batches):
        for batch in batches:
            column, rows, dims, packed = batch.column("embedding"), [], [], []
            for i in range(len(batch)):
                values = column[i].values
                if values is None or not len(values) or values.null_count:
                    continue
                vector = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(vector).all():
                    continue
                limit = _limit(len(vector))
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(scale * vector), -limit, limit)
                rows.append(i)
                dims.append(len(vector))
                packed.append(whole.astype("<i4").tobytes())
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(taken), batch.column("label").take(taken), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())],
                names=["vec_id", "label", "dim", "vec"],
            )

    return integers


def _cut(packed: pa.Array, parts: int, dim: int) -> np.ndarray:
    """(rows, parts, width) integers of a binary column."""
    data = np.frombuffer(b"".join(packed.to_pylist()), dtype="<i4")
    return data.reshape(len(packed), parts, dim // parts).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the entries, each as far as possible from those before it."""
    chosen = [0]
    far = squared(entries, entries[0])
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest(vectors: np.ndarray, seen: np.ndarray, entries: np.ndarray, pivots: np.ndarray):
    """Index and squared distance of the entry nearest to each vector, ties to the lower index.

    ``seen`` has the distances from the vectors to the pivots in single precision.
    """
    known = np.sqrt(squared(pivots[:, None, :], entries[None, :, :])).astype(np.float32)
    bound = np.zeros((len(vectors), len(entries)), dtype=np.float32)
    for p in range(len(pivots)):
        a, b = seen[:, p, None], known[p][None, :]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    rows = np.arange(len(vectors))
    best, index = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), dtype=np.int64)
    for _ in range(min(ORDERED, len(entries))):
        tried = bound.argmin(axis=1)
        found = squared(vectors, entries[tried])
        better = (found < best) | ((found == best) & (tried < index))
        best, index = np.where(better, found, best), np.where(better, tried, index)
        bound[rows, tried] = np.inf
    row, entry = np.nonzero(bound <= np.sqrt(best.astype(np.float64))[:, None] * (1 + 1e-9))
    if len(row):
        found = squared(vectors[row], entries[entry])
        # Of several entries of a row the least distance, then the lowest index, comes last.
        order = np.lexsort((-entry, -found, row))
        row, entry, found = row[order], entry[order], found[order]
        last = np.append(row[1:] != row[:-1], True)
        row, entry, found = row[last], entry[last], found[last]
        better = (found < best[row]) | ((found == best[row]) & (entry < index[row]))
        best[row[better]], index[row[better]] = found[better], entry[better]
    return index, best


def _measure(parts: int, pivots: list[np.ndarray]):
    """The rows with the distances of their parts to the pivots, once and for all rounds."""

    def measure(batches):
        for batch in batches:
            if not len(batch):
                continue
            dim = batch.column("dim")[0].as_py()
            cut = _cut(batch.column("vec"), parts, dim)
            seen = np.stack(
                [np.sqrt(squared(cut[:, j, None, :], pivots[j][None, :, :])) for j in range(parts)], axis=1
            ).astype("<f4")
            arrays = [batch.column(c) for c in ("vec_id", "label", "dim", "vec")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([row.tobytes() for row in seen], pa.binary())],
                names=["vec_id", "label", "dim", "vec", "seen"],
            )

    return measure


def _assigned(batch, parts: int, pivots, books):
    """(vectors cut into parts, index, squared distance), the last two for row and part."""
    cut = _cut(batch.column("vec"), parts, batch.column("dim")[0].as_py())
    seen = np.frombuffer(b"".join(batch.column("seen").to_pylist()), dtype="<f4").reshape(len(batch), parts, -1)
    index, far = zip(*[nearest(cut[:, j], seen[:, j], books[j], pivots[j]) for j in range(parts)])
    return cut, np.stack(index, axis=1), np.stack(far, axis=1)


def _sum(parts: int, pivots, books):
    """For each part, entry and position of the task's rows: their number and sum."""

    def summed(batches):
        entries, width = books[0].shape
        total = np.zeros((parts, entries, width), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            cut, index, _ = _assigned(batch, parts, pivots, books)
            for j in range(parts):
                np.add.at(total[j], index[:, j], cut[:, j])
                count[j] += np.bincount(index[:, j], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width), pa.int32()),
                pa.array(np.repeat(entry, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(part)), pa.int32()),
                pa.array(np.repeat(count[part, entry], width), pa.int64()),
                pa.array(total[part, entry].ravel(), pa.int64()),
            ],
            names=["part", "entry", "place", "n", "total"],
        )

    return summed


def _encode(parts: int, pivots, books):
    def encode(batches):
        for batch in batches:
            if not len(batch):
                continue
            _, index, far = _assigned(batch, parts, pivots, books)
            codes = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(far.sum(axis=1), pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return encode


@dataclass
class Compressed:
    """Codes of vectors, and what they stand for."""

    codes: DataFrame  #: vec_id, label, code, error
    books: list[np.ndarray]  #: for each part the entries, (entries, width) integers

    def flat(self) -> str:
        """All components by part, entry and position, joined by commas."""
        return ",".join(str(x) for book in self.books for x in book.ravel().tolist())


def compress_vectors(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, pivots: int = 4, scale: float = 256.0
) -> Compressed:
    """Codes of ``vectors`` (vec_id, embedding, label, ...) under codebooks fitted to them.

    Component x counts as the integer floor(scale * x). A codebook starts as its part of the
    vectors with the ``entries`` smallest vec_ids; each round assigns all parts to their
    nearest entries and replaces each used entry by the floors of its parts' means. ``code``
    has two hexadecimal digits for each part, ``error`` the sum of squared distances.

    Vectors that are null or empty or hold null or non-finite components are left out, and
    so are those whose length is not a multiple of ``parts``, or not that of the first
    vector. Integers are clipped where squared distances would not fit 64 bits (beyond
    2**27 for vectors of up to 128 components). Each of several rows with one vec_id counts,
    ordered by their components; a null vec_id comes last and is kept. With fewer rows than
    entries the codebooks are shorter; no rows give no codes and empty codebooks. A null
    label stays null; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    label = vectors.schema["label"].dataType.simpleString()
    vec_id = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = f"vec_id {vec_id}, label {label}, dim int, vec binary"
    usable = stored(rows.mapInArrow(_integers(scale), kind)).where(F.col("dim") % parts == 0)
    order = [F.col("vec_id").asc_nulls_last(), "dim", "vec"]
    first = usable.orderBy(*order).limit(1).collect()
    if not first:
        empty = spark.createDataFrame([], f"vec_id {vec_id}, label {label}, code string, error long")
        return Compressed(empty, [])
    dim = first[0]["dim"]
    same = usable.where(F.col("dim") == dim)
    starts = same.orderBy(*order).limit(entries).select("vec").collect()
    start = _cut(pa.array([bytes(r["vec"]) for r in starts], pa.binary()), parts, dim)
    books = [start[:, j].copy() for j in range(parts)]
    fixed = [choose_pivots(book, pivots) for book in books]
    measured = stored(same.mapInArrow(_measure(parts, fixed), f"{kind}, seen binary"))
    dropped(usable)
    for _ in range(rounds):
        sums = measured.mapInArrow(_sum(parts, fixed, books), "part int, entry int, place int, n long, total long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        # At most one row for each component of the codebooks.
        books = [book.copy() for book in books]
        for part, entry, place, n, total in sums.collect():
            books[part][entry, place] = total // n
    encode = _encode(parts, fixed, books)
    codes = stored(measured.mapInArrow(encode, f"vec_id {vec_id}, label {label}, code string, error long"))
    dropped(measured)
    return Compressed(codes, books)

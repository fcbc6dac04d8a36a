"""Words, shingles and windows of whole texts as 64-bit hashes, for many texts at a time.

A word is a maximal run of bytes other than space and tab to carriage return
(``[^\\x20\\x09-\\x0D]+``). UTF-8 never uses these bytes inside a character, so the texts
are scanned as bytes. All loops run inside numpy; memory is bounded by ``CHUNK`` bytes of
text, or by the longest single text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text scanned together.
CHUNK = 1 << 20
#: Bytes hashed together; a segment ends at white space, so a longer word makes it longer.
SEGMENT = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHash:
    """Polynomial hash of words modulo 2**64 over random byte values, from one seed.

    Two hashes of different seeds are independent for our purposes; together they are the
    128 bits by which windows and sets are told apart.
    """

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.values = random.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = (int(random.integers(1 << 40, 1 << 62)) << 1 | 1) & _MASK
        self.inverse = pow(self.base, -1, 1 << 64)
        #: Odd multipliers by which hashes of neighbouring words are combined.
        self.step = np.uint64((int(random.integers(1 << 40, 1 << 62)) << 1 | 1) & _MASK)
        self._powers = self._inverses = np.ones(1, dtype=np.uint64)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n:
            n = max(n, SEGMENT + 1)
            for name, factor in (("_powers", self.base), ("_inverses", self.inverse)):
                table = np.full(n, np.uint64(factor), dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self._powers, self._inverses

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each word ``data[start:end]``; words are in order and do not overlap."""
        out = np.empty(len(starts), dtype=np.uint64)
        first = 0
        while first < len(starts):
            at = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
            piece = data[at : ends[last - 1]]
            powers, inverses = self._tables(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(self.values[piece] * powers[: len(piece)], out=sums[1:])
            s, e = starts[first:last] - at, ends[first:last] - at
            out[first:last] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64))
            first = last
        return out

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of every ``k`` consecutive words, ``len(words) - k + 1`` of them."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = words[:n].copy()
        for i in range(1, k):
            out *= self.step
            out += words[i : i + n]
        return mix(out)


@dataclass
class Texts:
    """Consecutive rows of a batch with the words of their texts."""

    first_row: int
    data: np.ndarray  #: bytes of the texts, a space after each
    starts: np.ndarray  #: of words, in ``data``
    ends: np.ndarray
    bounds: np.ndarray  #: row i has the words bounds[i] to bounds[i + 1] - 1

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def scan(column: pa.Array, lower: bool = False) -> Iterator[Texts]:
    """The words of a string column, about ``CHUNK`` bytes of texts at a time.

    A null is a text without words. ``lower`` turns A-Z into a-z first.
    """
    texts = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    row = 0
    while row < len(texts):
        group, size = [], 0
        while row + len(group) < len(texts) and (not group or size < CHUNK):
            text = texts[row + len(group)].as_py() or b""
            size += len(text) + 1
            group.append(text)
        data = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        space = _SPACE[data]
        word = ~space
        starts = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in group])))
        yield Texts(row, data, starts, ends, np.searchsorted(starts, offsets))
        row += len(group)


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)

"""SentencePiece encoding with sampled segmentations, and lossless decoding.

Every text is a lattice of vocabulary pieces. Forward filtering sums, for each place, the
weights of all ways to reach it; backward sampling then draws the pieces from the end to
the start in proportion to these sums, so that a segmentation comes up with its exact
probability under ``piece weight = (1 - score) ** -sharpness`` (scores of this kind of
vocabulary are minus the rank). The draws are hashes of seed, row key and place: the same
row gives the same pieces on any executor and in any partition.

No piece runs from a letter into a space, so the lattice falls apart into units (the
spaces before a word, and the word). The lattice of a unit is built once for each chunk of
text, or once for a worker if it is among the first ``KNOWN`` characters of units, and the
draws of all units of a chunk go step by step in numpy.

A text need not have spaces. A long unit falls apart further wherever no piece of the
vocabulary spans a place; that is found in windows. What is still long, such as one letter
a million times, is walked block by block: the sums are kept at the blocks' beginnings only
and made again for a block when its pieces are drawn. A draw depends on the unit's key and
the place in it, so the same pieces come out whichever way is taken.
"""

from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .words import mix, signed

SPACE = "▁"
#: Characters whose units are sampled together.
CHUNK = 1 << 19
#: Longer units are looked through for places that no piece spans.
LONG = 1024
#: Longer parts of them are walked block by block.
WALKED = 2048
#: Characters of a window, and of a block that is walked.
WINDOW = 1 << 16
#: Characters of units whose lattices a worker keeps for its next chunks, some 200 bytes each.
KNOWN = 1 << 19
#: Stands for a literal U+2581 in a text, which the vocabulary uses for the space.
LITERAL = chr(0xF0000)


class Pieces:
    """The vocabulary: pieces that can be chosen, their weights, and their bytes."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte_ids, self.weights, texts = {}, {}, [b""] * n
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                texts[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.weights[text] = (i, (1.0 - model.get_score(i)) ** -sharpness)
                texts[i] = text.replace(SPACE, " ").encode()
                if SPACE in text.lstrip(SPACE):
                    raise ValueError(f"piece {text!r} goes on after a space")
        self.longest = max(map(len, self.weights))
        self.rarest = n**-sharpness
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        keyed = sorted((self._key(t), i, w) for t, (i, w) in self.weights.items())
        self.sorted_keys = np.array([k for k, _, _ in keyed], dtype=np.uint64)
        self.sorted_ids = np.array([i for _, i, _ in keyed], dtype=np.int32)
        self.sorted_weights = np.array([w for _, _, w in keyed])
        if (np.diff(self.sorted_keys.astype(object)) == 0).any():
            raise ValueError("two pieces have the same key")
        # Keys by their first 20 bits: whether there are any, the first one, and the most but one.
        count = np.bincount((self.sorted_keys >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
        self.maybe, self.first_key, self.steps = count > 0, (np.cumsum(count) - count).astype(np.int32), int(count.max()) - 1
        # Lattices: numbers of the units kept, their lengths and places in the tables below.
        self.known, self.kept = {}, 0
        self.lengths, self.begin = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._reserve(0)

    def _key(self, text: str) -> int:
        codes = _codes(text)
        found = [keys for _, keys in self.keys(codes, np.arange(len(codes)))]
        return int(found[len(codes) - 1][-1])

    def keys(self, codes: np.ndarray, place: np.ndarray):
        """(ends, 64-bit keys) of the substrings of 1, 2, ... characters inside units."""
        own, base = mix(codes.astype(np.uint64) + np.uint64(1)), 0x9FB21C651E98DF25
        ends, total, factor = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64), 1
        for n in range(self.longest):
            inside = place[ends] >= n
            ends, total = ends[inside], total[inside]
            total = total + own[ends - n] * np.uint64(factor)
            factor = factor * base & 0xFFFFFFFFFFFFFFFF
            yield ends, mix(total + np.uint64(n + 1))

    def edges(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and weight of the substrings that end at each character, by length - 1.

        -1 and 0 where there is no piece. A character without a piece of its own has the
        piece -2, its bytes, which weigh as much as the rarest piece.
        """
        ids = np.full((len(codes), self.longest), -1, dtype=np.int32)
        weights = np.zeros((len(codes), self.longest))
        for n, (ends, keys) in enumerate(self.keys(codes, place)):
            bits = (keys >> np.uint64(44)).astype(np.int64)
            at = np.flatnonzero(self.maybe[bits])
            found, wanted = self.first_key[bits[at]], keys[at]
            for _ in range(self.steps):
                other = np.flatnonzero(self.sorted_keys[found] != wanted)
                found[other] = np.minimum(found[other] + 1, len(self.sorted_keys) - 1)
            same = self.sorted_keys[found] == wanted
            at, found = ends[at[same]], found[same]
            ids[at, n] = self.sorted_ids[found]
            weights[at, n] = self.sorted_weights[found]
        alone = np.flatnonzero(ids[:, 0] < 0)
        ids[alone, 0], weights[alone, 0] = -2, self.rarest
        return ids, weights

    def spell(self, code: int) -> list[int]:
        """The byte pieces of a character."""
        return [self.byte_ids[b] for b in (SPACE if chr(code) == LITERAL else chr(code)).encode()]

    def filter_forward(self, lengths: np.ndarray, place: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Chances of backward sampling: at each character the cumulative chance of a piece
        of 1, 2, ... characters to end there, given that a piece ends there.

        All units go on by one character at a time.
        """
        width, units = self.longest, len(lengths)
        unit = np.repeat(np.arange(units), lengths)
        ahead = np.ones(len(place) + units)  # of each place between characters
        back = np.arange(1, width + 1)
        chances = np.ones_like(weights)
        order = np.argsort(place, kind="stable")
        begin = np.concatenate(([0], np.cumsum(np.bincount(place))))
        for p in range(len(begin) - 1):
            rows, wide = order[begin[p] : begin[p + 1]], min(p + 1, width)
            end = rows + unit[rows] + 1
            sums = np.cumsum(ahead[end[:, None] - back[:wide]] * weights[rows, :wide], axis=1)
            total = sums[:, -1]
            ahead[end] = total
            # The last chance stays 1.
            chances[rows, : wide - 1] = sums[:, :-1] / total[:, None]
            for i in np.flatnonzero(total < 1e-100):
                # Only ratios within a unit matter, and only the last places count on.
                last = slice(end[i] - wide, end[i] + 1)
                ahead[last] /= total[i]
        return chances

    def free_places(self, codes: np.ndarray) -> np.ndarray:
        """Places between characters that no piece spans, with both ends."""
        spans = np.zeros(len(codes) + 2, dtype=np.int64)
        for a in range(0, len(codes), WINDOW):
            from_ = max(0, a - self.longest + 1)
            window = codes[from_ : a + WINDOW]
            ids, _ = self.edges(window, np.arange(len(window)))
            end, n = np.nonzero(ids[a - from_ :, 1:] >= 0)
            end += a
            np.add.at(spans, end - n, 1)
            np.add.at(spans, end + 1, -1)
        free = np.flatnonzero(np.cumsum(spans[: len(codes)]) == 0)
        return np.unique(np.concatenate(([0], free, [len(codes)])))

    def walk(self, codes: np.ndarray, key: int, offset: int) -> np.ndarray:
        """Pieces of one part of a unit that begins ``offset`` characters after its start."""
        width, begins = self.longest, range(0, len(codes), WINDOW)

        def block(a: int, before: list[float], drawing: bool):
            """Pieces that end at each place of a block, the cumulative chances of them, and
            the last ``width`` sums; ``before`` has those of the block before."""
            from_ = max(0, a - width + 1)
            window = codes[from_ : a + WINDOW]
            ids, weights = self.edges(window, np.arange(len(window)))
            ids, chances, ahead = ids[a - from_ :].tolist() if drawing else [], [], list(before)
            for row in weights[a - from_ :].tolist():
                sums, total = [], 0.0
                for n in range(min(width, len(ahead))):
                    total += ahead[-1 - n] * row[n]
                    sums.append(total)
                if drawing:
                    chances.append([x / total for x in sums[:-1]])
                ahead.append(total)
                if len(ahead) > width:
                    del ahead[0]
                if total < 1e-100:
                    # Only ratios matter, and only the last places count on.
                    ahead = [x / total for x in ahead]
            return ids, chances, ahead

        sums, starts = [1.0], []
        for a in begins:
            starts.append(sums)
            sums = block(a, sums, False)[2]
        drawn, left = [], len(codes)
        for a in reversed(begins):
            ids, chances, _ = block(a, starts.pop(), True)
            lefts = (offset + np.arange(a + 1, left + 1)).astype(np.uint64)
            random = mix(np.uint64(key) + np.uint64(0x9E3779B97F4A7C15) * lefts)
            points = ((random >> np.uint64(11)).astype(np.float64) / (1 << 53)).tolist()
            while left > a:
                at = left - a - 1
                size = 0
                while size < len(chances[at]) and chances[at][size] <= points[at]:
                    size += 1
                piece = ids[at][size]
                drawn += [piece] if piece >= 0 else reversed(self.spell(int(codes[left - 1])))
                left -= size + 1
        return np.array(drawn[::-1], dtype=np.int32)

    def _reserve(self, size: int) -> None:
        """Tables of lattices for ``size`` characters, with what is kept."""
        shapes = ("codes", (size,), np.uint32), ("ids", (size, self.longest), np.int32), ("chances", (size, self.longest), np.float64)
        for name, shape, kind in shapes:
            table = np.empty(shape, dtype=kind)
            if self.kept:
                table[: self.kept] = getattr(self, name)[: self.kept]
            setattr(self, name, table)

    def lattices(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each unit, and by number the lengths and the places in the tables.

        Lattices that are not known are built behind those kept, and stay until the next
        call; the first of them are kept as long as all kept ones have ``KNOWN`` characters.
        """
        which = np.fromiter(map(self.known.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        new = [units[i] for i in np.flatnonzero(which < 0).tolist()]
        if not new:
            return which, self.lengths, self.begin
        number = {unit: i for i, unit in enumerate(dict.fromkeys(new), len(self.known))}
        which[which < 0] = np.fromiter(map(number.__getitem__, new), dtype=np.int64, count=len(new))
        lengths = np.fromiter(map(len, number), dtype=np.int64, count=len(number))
        ends = np.cumsum(lengths)
        codes = _codes("".join(number))
        place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        ids, weights = self.edges(codes, place)
        rows = slice(self.kept, self.kept + len(codes))
        if rows.stop > len(self.codes):
            self._reserve(KNOWN + max(len(codes), CHUNK))
        self.codes[rows], self.ids[rows] = codes, ids
        self.chances[rows] = self.filter_forward(lengths, place, weights)
        all_lengths = np.concatenate((self.lengths, lengths))
        all_begin = np.concatenate((self.begin, self.kept + ends - lengths))
        stay = int(np.searchsorted(ends, KNOWN - self.kept, "right"))
        if stay:
            self.known.update(islice(number.items(), stay))
            self.lengths, self.begin = all_lengths[: len(self.known)], all_begin[: len(self.known)]
            self.kept += int(ends[stay - 1])
        return which, all_lengths, all_begin

    def sample(self, units: list[str], keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in text order and how many of them each unit has.

        ``keys`` are random 64-bit numbers, one for a unit; a part of a unit comes with the
        unit's key and the ``offset`` at which it begins. Equal units share a lattice.
        """
        which, lengths, begin = self.lattices(units)
        codes, ids, chances = self.codes, self.ids, self.chances
        rows, left, first = np.arange(len(units)), lengths[which], begin[which]
        drawn, spelled = [], np.zeros(len(units), dtype=np.int64)
        counts = np.zeros(len(units), dtype=np.int64)
        while len(rows):
            end = first[rows] + left - 1
            random = mix(keys[rows] + np.uint64(0x9E3779B97F4A7C15) * (left + offsets[rows]).astype(np.uint64))
            point = (random >> np.uint64(11)).astype(np.float64) / (1 << 53)
            size, longer = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
            for n in range(self.longest - 1):
                longer = longer[chances[end[longer], n] <= point[longer]]
                if not len(longer):
                    break
                size[longer] = n + 1
            piece = ids[end, size]
            odd = np.flatnonzero(piece == -2)
            piece[odd] = -3 - codes[end[odd]].astype(np.int32)
            drawn.append((rows, piece, counts[rows].copy()))
            counts[rows] += 1
            left = left - size - 1
            more = left > 0
            rows, left = rows[more], left[more]
        out = np.empty(int(counts.sum()), dtype=np.int32)
        stop = np.cumsum(counts)
        for rows, piece, step in drawn:
            out[stop[rows] - 1 - step] = piece
        odd = np.flatnonzero(out < 0)
        if len(odd):
            # Byte pieces in the place of a character.
            bytes_of = [self.spell(-3 - int(x)) for x in out[odd]]
            repeat = np.ones(len(out), dtype=np.int64)
            repeat[odd] = [len(x) for x in bytes_of]
            owner = np.repeat(np.repeat(np.arange(len(units)), counts), repeat)
            at = (np.cumsum(repeat) - repeat)[odd]
            out = np.repeat(out, repeat)
            for i, x in zip(at.tolist(), bytes_of):
                out[i : i + len(x)] = x
            counts = np.bincount(owner, minlength=len(units))
        return out, counts


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=2)
def _pieces(path: str, sharpness: float) -> Pieces:
    return Pieces(path, sharpness)


def units_of(text: str) -> list[str]:
    """Units of a text as the vocabulary writes it, with the space put before it."""
    if not text:
        return []
    words = text.replace(SPACE, LITERAL).split(" ")
    units, spaces = [], 0
    for word in words:
        spaces += 1
        if word:
            units.append(SPACE * spaces + word)
            spaces = 0
    if spaces:
        units.append(SPACE * spaces)
    return units


def _parts(pieces: Pieces, units: list[str]):
    """(parts, unit, offset): long units in parts that no piece spans, others as they are."""
    if not units or max(map(len, units)) <= LONG:
        return units, np.arange(len(units)), np.zeros(len(units), dtype=np.int64)
    parts, unit, offsets = [], [], []
    for i, text in enumerate(units):
        cuts = pieces.free_places(_codes(text)).tolist() if len(text) > LONG else [0, len(text)]
        parts += [text[a:b] for a, b in zip(cuts, cuts[1:])]
        unit += [i] * (len(cuts) - 1)
        offsets += cuts[:-1]
    return parts, np.array(unit, dtype=np.int64), np.array(offsets, dtype=np.int64)


def _sample(pieces: Pieces, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``Pieces.sample``, about ``CHUNK`` characters or one long part at a time."""
    parts, unit, offsets = _parts(pieces, units)
    ids, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends, walked = np.cumsum(lengths), np.append(np.flatnonzero(lengths > WALKED), len(parts))
    first = 0
    while first < len(parts):
        if lengths[first] > WALKED:
            out = pieces.walk(_codes(parts[first]), int(keys[unit[first]]), int(offsets[first]))
            ids.append(out)
            counts.append(np.array([len(out)]))
            first += 1
            continue
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        last = min(last, int(walked[np.searchsorted(walked, first)]))
        for out, part in zip((ids, counts), pieces.sample(parts[first:last], keys[unit[first:last]], offsets[first:last])):
            out.append(part)
        first = last
    per_unit = np.zeros(len(units), dtype=np.int64)
    np.add.at(per_unit, unit, np.concatenate(counts))
    return np.concatenate(ids), per_unit


def _encode(path: str, sharpness: float, seed: int, kept: list[str]):
    def encode(batches):
        pieces = _pieces(path, sharpness)
        for batch in batches:
            texts, row_keys = batch.column("spm__text"), batch.column("spm__key").to_numpy(zero_copy_only=False)
            row = 0
            while row < len(batch):
                group, units, counts, size = [], [], [], 0
                while row + len(group) < len(batch) and (not group or size < CHUNK):
                    text = texts[row + len(group)].as_py()
                    found = units_of(text or "")
                    group.append(text)
                    units += found
                    counts.append(len(found))
                    size += len(text or "")
                n = len(group)
                counts = np.array(counts, dtype=np.int64)
                owner = np.repeat(np.arange(n), counts)
                place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
                keys = mix(row_keys[row : row + n].view(np.uint64) + np.uint64(seed))
                keys = mix(keys[owner] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                ids, per_unit = _sample(pieces, units, keys)
                ends = np.concatenate(([0], np.cumsum(per_unit)))
                bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
                decoded = decode_flat(pieces, ids, bounds)
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds.astype(np.int32)), pa.array(ids),
                    mask=pa.array([t is None for t in group]),
                )
                lossless = [t is None or d == t.encode() for t, d in zip(group, decoded)]
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept]
                    + [pa.array(np.diff(bounds)), lists, pa.array(lossless)],
                    names=[*kept, "n_pieces", "pieces", "lossless"],
                )
                row += n

    return encode


def decode_flat(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Texts of rows of pieces: their bytes in a row, without the space put before."""
    sizes = pieces.sizes[ids]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(ends[-1]) + np.repeat(pieces.begins[ids] - ends[:-1], sizes)
    data = pieces.bytes[at].tobytes()
    cuts = ends[bounds].tolist()
    return [data[a + (b > a) : b] for a, b in zip(cuts, cuts[1:])]


def encode_pieces(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", sharpness: float = 1.0, seed: int = 0, keep: tuple | None = None
) -> DataFrame:
    """The columns in ``keep`` (all by default), n_pieces, pieces (ids) and lossless.

    ``path`` names the vocabulary file, which every executor has at that place. A larger
    ``sharpness`` favours likely segmentations; rows draw by ``seed``, ``key`` and place,
    so that equal rows get equal pieces. ``lossless`` tells whether decoding gave back the
    text byte by byte.

    A null text has null pieces and n_pieces 0, an empty one has no pieces. A null key is
    a key like others. Columns of ``docs`` named n_pieces, pieces or lossless give way to
    the new ones. No shuffle.
    """
    ship(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_pieces", "pieces", "lossless")]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.xxhash64(F.col(f"`{key}`").cast("string")).alias("spm__key"),
        F.col(f"`{text}`").alias("spm__text"),
    )
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(kept)])
    out = f"{kinds}n_pieces long, pieces array<int>, lossless boolean"
    return rows.mapInArrow(_encode(path, sharpness, seed, kept), out)


def _decode(path: str, column: str):
    def decode(batches):
        pieces = _pieces(path, 1.0)
        for batch in batches:
            lists = batch.column(column)
            flat, lengths = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            ids = flat.fill_null(0).to_numpy().astype(np.int64)
            ids = np.where((ids >= 0) & (ids < len(pieces.sizes)), ids, 0)
            texts = decode_flat(pieces, ids, np.concatenate(([0], np.cumsum(lengths))))
            texts = [t.decode("utf-8", "replace") if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names] + [pa.array(texts, pa.string())],
                names=[*batch.schema.names, "decoded"],
            )

    return decode


def decode_pieces(rows: DataFrame, path: str, column: str = "pieces") -> DataFrame:
    """``rows`` with the text of their pieces as ``decoded``.

    Null pieces give null, no pieces an empty text; null and unknown ids, and control
    pieces, stand for nothing. Bytes that are not UTF-8 become U+FFFD.
    """
    ship(rows.sparkSession)
    rows = rows.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(path, column), f"{kinds}, decoded string")

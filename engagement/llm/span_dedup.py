"""Substring de-duplication over a De Bruijn graph of the corpus, sampled at anchors.

Words that lie in a window of ``window`` words which already occurred earlier are removed.

A window's ``k``-word edge with the smallest hash is its *anchor* (the leftmost of equal
ones), so equal windows have equal anchors at equal offsets. Of the k-mers only anchors are
shuffled, about one for every ``(window - k) / 2`` words:

1. anchors whose hash occurs once cannot lie in a repeated window; they go;
2. a node of the graph is an anchor with the words around it, as far as any window of the
   anchor reaches: all windows repeat there exactly where the node does. An edge leads to
   the next anchor of the text, if its windows follow without a gap. An aggregation by
   node gives its degrees, in which a text's end or a gap counts as a branch;
3. nodes joined by an edge that is the only one out of the one and into the other compact
   to paths, by joins that double what is known of a path in each round. All occurrences
   of a path are alike, so it is its head that is looked up in the sources: where that is
   not the first (smallest doc_id, then place), the whole path is a repeated span;
4. where an anchor has several nodes, as at the ends of shared passages, the windows at
   the first occurrence of each of them are hashed and grouped one by one;
5. the windows that are not first are laid on the source text by their coordinates, where
   runs of them make spans.

Windows are told apart by 128 bits (two independent hashes over all their words).
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, stored
from .ship import ship
from .words import Texts, WordHash, scan, signed

FIRST, SECOND = WordHash(11), WordHash(12)


def _anchors(texts: Texts, words: np.ndarray, window: int, k: int):
    """Of each anchor: its word, row, and the first and last window it stands for."""
    edges = FIRST.runs(words, k)
    count, reach = len(words) - window + 1, window - k + 1
    if count <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return edges, empty, empty, empty, empty
    least, at = edges[:count].copy(), np.zeros(count, dtype=np.int64)
    for i in range(1, reach):
        smaller = edges[i : i + count] < least
        np.copyto(least, edges[i : i + count], where=smaller)
        at[smaller] = i
    row = np.repeat(np.arange(texts.rows), np.diff(texts.bounds))
    starts = np.flatnonzero(texts.bounds[row[:count] + 1] - np.arange(count) >= window)
    anchor = starts + at[starts]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(row[starts]) != 0)))) if len(starts) else starts
    last = np.concatenate((new[1:], [len(starts)])) - 1 if len(starts) else starts
    return edges, anchor[new], row[starts[new]], starts[new], starts[last]


def _around(words: np.ndarray, low: np.ndarray, high: np.ndarray, longest: int) -> np.ndarray:
    """Second hash of the words low to high - 1 for spans of at most ``longest`` words."""
    out = np.zeros(len(low), dtype=np.uint64)
    for i in range(longest):
        inside = low + i < high
        out = np.where(inside, out * SECOND.step + words[np.minimum(low + i, len(words) - 1)], out)
    return out


#: A place is the word number in the upper half and the mark in the lower; reach holds how
#: many words before the anchor the first and the last of its windows start, a byte each.
ANCHOR = "doc_id long, place long, h long, around long, reach int"


def _find_anchors(window: int, k: int):
    def find(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark").to_numpy()
            for texts in scan(batch.column("text")):
                words = FIRST.words(texts.data, texts.starts, texts.ends)
                edges, anchor, row, first, last = _anchors(texts, words, window, k)
                if not len(anchor):
                    continue
                begin, end = texts.bounds[row], texts.bounds[row + 1]
                low = np.maximum(anchor - (window - k), begin)
                high = np.minimum(anchor + window, end)
                second = SECOND.words(texts.data, texts.starts, texts.ends)
                around = _around(second, low, high, 2 * window - k)
                # How far the text reaches on either side is part of the surroundings.
                around = around * SECOND.step + (anchor - low).astype(np.uint64)
                around = around * SECOND.step + (high - anchor).astype(np.uint64)
                place = ((anchor - begin) << 32) | marks[row + texts.first_row].view(np.uint32)
                reach = ((anchor - first) << 8) | (anchor - last)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row + texts.first_row)),
                        pa.array(place),
                        pa.array(signed(edges[anchor])),
                        pa.array(signed(around)),
                        pa.array(reach.astype(np.int32)),
                    ],
                    names=["doc_id", "place", "h", "around", "reach"],
                )

    return find


WINDOW = "doc_id long, place long, h long, g long"


def _hash_windows(window: int):
    """Both hashes of the windows that ``spans`` (first, last) name in each text."""

    def windows(batches):
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans")
            marks = batch.column("mark").to_numpy()
            for texts in scan(batch.column("text")):
                words = FIRST.words(texts.data, texts.starts, texts.ends)
                second = SECOND.words(texts.data, texts.starts, texts.ends)
                rows, at = [], []
                for i in range(texts.rows):
                    for span in spans[texts.first_row + i].as_py() or ():
                        place = np.arange(span["first"], span["last"] + 1)
                        rows.append(np.full(len(place), texts.first_row + i))
                        at.append(place + texts.bounds[i])
                if not rows:
                    continue
                row, at = np.concatenate(rows), np.concatenate(at)
                h, g = FIRST.runs(words, window)[at], SECOND.runs(second, window)[at]
                place = ((at - texts.bounds[row - texts.first_row]) << 32) | marks[row].view(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(place), pa.array(signed(h)), pa.array(signed(g))],
                    names=["doc_id", "place", "h", "g"],
                )

    return windows


KEPT = "n_words long, n_removed long, kept_text string, kept_sha256 string"


def _remove(window: int, keep_columns: list[str], keep_text: bool):
    def remove(batches):
        for batch in batches:
            spans = batch.column("spans")
            for texts in scan(batch.column("text")):
                out = {"n_words": [], "n_removed": [], "kept_text": [], "kept_sha256": []}
                raw = texts.data.tobytes()
                for i in range(texts.rows):
                    a, b = texts.bounds[i], texts.bounds[i + 1]
                    begin = int(texts.starts[a]) if b > a else 0
                    stop = int(texts.ends[b - 1]) if b > a else 0
                    words = raw[begin:stop].split()
                    found = spans[texts.first_row + i].as_py()
                    if found:
                        change = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(change, [s["first"] for s in found], 1)
                        np.add.at(change, [s["last"] + window for s in found], -1)
                        kept = [w for w, c in zip(words, np.cumsum(change).tolist()) if not c]
                    else:
                        kept = words
                    text = b" ".join(kept)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["kept_text"].append(text.decode("utf-8", "replace") if keep_text else None)
                    out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                part = batch.slice(texts.first_row, texts.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep_columns]
                    + [pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64())]
                    + [pa.array(out[c], pa.string()) for c in ("kept_text", "kept_sha256")],
                    names=keep_columns + list(out),
                )

    return remove


def _spans(rows: DataFrame) -> DataFrame:
    """The spans of each document as one array."""
    return rows.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Null doc_ids meet as well."""
    spans = spans.withColumnRenamed("doc_id", "spans_id").withColumnRenamed("mark", "spans_mark")
    same = docs["doc_id"].eqNullSafe(spans["spans_id"]) & (docs["mark"] == spans["spans_mark"])
    return docs.join(spans, same, how).drop("spans_id", "spans_mark")


def _first(*also) -> Column:
    """The earliest occurrence: smallest doc_id (null is smallest), then place."""
    return F.min(F.struct("doc_id", "place", *also)).alias("earliest")


def _is_first() -> Column:
    same_id = F.col("earliest.doc_id").eqNullSafe(F.col("doc_id"))
    return same_id & (F.col("earliest.place") == F.col("place"))


def _pos() -> Column:
    return F.shiftright("place", 32).cast("int")


def _mark() -> Column:
    return F.shiftright(F.shiftleft("place", 32), 32).cast("int").alias("mark")


def _reached() -> list[Column]:
    """Columns doc_id, mark, first, last of the windows of an anchor."""
    first = (_pos() - F.shiftright("reach", 8)).alias("first")
    last = (_pos() - F.col("reach").bitwiseAND(255)).alias("last")
    return ["doc_id", _mark(), first, last]


def _nodes(seen: DataFrame) -> DataFrame:
    """The nodes: id, h, around, earliest occurrence, and their only neighbours.

    ``next`` and ``before`` are the key of the only node that follows or comes before, null
    where there are several, or a text ends or has a gap; ``step`` is how many words on the
    next one lies. Neighbours are told apart by a hash of 64 bits within one node.
    """
    text = Window.partitionBy("doc_id", "mark").orderBy("place")
    first, last = _pos() - F.shiftright("reach", 8), _pos() - F.col("reach").bitwiseAND(255)
    rows = seen.select("*", _mark(), F.struct("h", "around").alias("node"), first.alias("first"), last.alias("last"), _pos().alias("pos"))

    def neighbour(move, meets) -> Column:
        there = F.struct(move("node").over(text).alias("node"), move("pos").over(text).alias("pos"))
        return F.when(meets, there)

    rows = rows.select(
        "doc_id", "place", "reach", "h", "around", "pos",
        neighbour(F.lead, F.lead("first").over(text) == F.col("last") + 1).alias("next"),
        neighbour(F.lag, F.lag("last").over(text) + 1 == F.col("first")).alias("before"),
    )

    def only(side: str) -> Column:
        key = F.xxhash64(f"{side}.node")
        alike = (F.count(side) == F.count("*")) & (F.min(key) == F.max(key))
        return F.when(alike, F.first(f"{side}.node"))

    nodes = rows.groupBy("h", "around").agg(
        _first("reach"), F.count("*").alias("n"), only("next").alias("next"), only("before").alias("before"),
        F.first(F.col("next.pos") - F.col("pos")).alias("step"),
    )
    return nodes.withColumn("id", F.monotonically_increasing_id())


def compact_paths(nodes: DataFrame) -> DataFrame:
    """(id, head, words): the head of each node's path, and how many words it lies behind it.

    ``nodes`` has (id, h, around, n, next, before, step) as ``_nodes`` gives them. An edge
    is part of a path if it is the only one out of its first node and into its second. Every
    round joins the pointers with themselves, so a path of m nodes takes log2(m) of them;
    a path cannot be a circle, as it would have no end in any text.
    """
    many = nodes.where("n > 1")
    ends = many.where("before is not null").select(F.col("id").alias("to"), F.struct("h", "around").alias("key"), "before")
    edges = many.where("next is not null").select(F.col("id").alias("up"), F.struct("h", "around").alias("own"), F.col("next").alias("key"), "step")
    pointers = ends.join(edges, "key").where(F.col("before") == F.col("own")).select(F.col("to").alias("id"), "up", F.col("step").cast("long").alias("words"))
    pointers = stored(pointers)
    while True:
        above = pointers.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("words").alias("more"))
        met = pointers.join(above, "up", "left")
        more = F.coalesce("more", F.lit(0))
        jumped = stored(met.select("id", F.coalesce("top", "up").alias("up"), (F.col("words") + more).alias("words"), F.col("top").isNotNull().alias("went")))
        dropped(pointers)
        pointers = jumped.drop("went")
        if jumped.where("went").isEmpty():
            inner = jumped.select("id", F.col("up").alias("head"), "words")
            heads = nodes.select("id").join(inner.select("id"), "id", "left_anti")
            return inner.unionByName(heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("words")))
        pointers = jumped.drop("went")


def repeated_windows(docs: DataFrame, window: int = 20, k: int = 6) -> DataFrame:
    """(doc_id, mark, first, last): runs of windows that occurred earlier.

    ``docs`` has (doc_id, mark, text); see ``dedup_spans`` for ``mark``.
    """
    anchors = stored(docs.mapInArrow(_find_anchors(window, k), ANCHOR))
    repeated = anchors.groupBy("h").count().where("count > 1").select("h")
    seen = stored(anchors.join(repeated, "h", "left_semi"))
    dropped(anchors)
    nodes = stored(_nodes(seen))
    # The last window of a path is that of its last node.
    paths = compact_paths(nodes).join(nodes.select("id", "earliest.reach"), "id")
    tail = F.max(F.struct(F.col("words"), F.col("reach").bitwiseAND(255).alias("back"))).alias("tail")
    heads = paths.groupBy(F.col("head").alias("id")).agg(tail).join(nodes.where("n > 1").select("id", "h", "around", "earliest"), "id")
    met = seen.join(heads.drop("id"), ["h", "around"]).where(~_is_first())
    first = (_pos() - F.shiftright("reach", 8)).alias("first")
    later = stored(met.select("doc_id", _mark(), first, (_pos() + F.col("tail.words") - F.col("tail.back")).cast("int").alias("last")))
    dropped(seen)
    # The surroundings decide all windows of an anchor, so only the first occurrence of
    # each kind of surroundings can hold a window's first occurrence.
    branching = nodes.groupBy("h").count().where("count > 1").select("h")
    ends = nodes.join(branching, "h", "left_semi").select("earliest.*").select(*_reached())
    windows = stored(_with_spans(docs, _spans(ends), "inner").mapInArrow(_hash_windows(window), WINDOW))
    dropped(nodes)
    earliest = windows.groupBy("h", "g").agg(F.count("*").alias("n"), _first()).where("n > 1").drop("n")
    again = windows.join(earliest, ["h", "g"]).where(~_is_first())
    again = stored(again.select("doc_id", _mark(), _pos().alias("first"), _pos().alias("last")))
    dropped(windows)
    return later.union(again)


def dedup_spans(docs: DataFrame, window: int = 20, k: int = 6, keep_text: bool = True, keep: tuple = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256, and the columns in ``keep``.

    Every word covered by a window of ``window`` words is removed if the same words start
    earlier: in a smaller doc_id (null is the smallest), or in the same document at an
    earlier word. Windows are judged on the input. ``kept_text`` joins the kept words by
    one space (null when ``keep_text`` is false) and ``kept_sha256`` is its SHA-256.

    A null or empty text has no words; one shorter than a window keeps them all. Rows that
    share a doc_id are one document: windows at the same place of equal texts are not
    earlier than each other; of different texts the one with the smaller text hash is. An
    empty table gives an empty result. ``docs`` may have any other columns.
    """
    if not 1 <= k <= window <= k + 255:
        raise ValueError("k must lie between window - 255 and window")
    ship(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.hash("text").alias("mark"),
        *[F.col(c).alias(f"kept__{c}") for c in keep],
    )
    spans = _spans(repeated_windows(docs.select("doc_id", "mark", "text"), window, k))
    names = ["doc_id", *[f"kept__{c}" for c in keep]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    out = _with_spans(docs, spans, "left").mapInArrow(_remove(window, names, keep_text), f"{kinds}, {KEPT}")
    return out.withColumnsRenamed({f"kept__{c}": c for c in keep})

"""Similarity join of documents on the Jaccard similarity of their word shingles.

T-occurrence search after DivideSkip (Li, Lu, Lu 2008), spread over Spark:

1. a sketch with a fixed number of counters, filled from all texts, estimates in how many
   documents a shingle lies and so orders inverted lists from short to long;
2. a document of n shingles that needs T common ones is posted under its n - T + c
   shortest lists; documents that reach T share c of them or more. Of copies of one set
   most are left out;
3. lists of up to ``SHORT`` documents count the common lists of each pair; the members of
   a longer list are only chained to its first member. Lists are made from slices of the
   shingles, one after the other. Candidates so found fall into groups that share no pair
   with each other;
4. every group, in blocks of bounded size, is searched with all its shingles: the short
   inverted lists are merged, the long ones probed by binary search in the sorted set of
   each document that can still reach T, and only links that join two parts come out. A
   group of several blocks is dealt out twice, by different hashes, and its blocks are
   searched alone; that joins most of what belongs together. Then all blocks are searched
   against each other, but those of the largest part found only against the others.

No link is lost: steps 1 to 3 only rule out what cannot reach T, step 4 is exact.
"""

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keyfilter import key_filter
from .graph import components
from .scratch import dropped, stored
from .ship import ship
from .words import Texts, WordHash, scan, signed

HASH = WordHash(21)
#: Counters of the sketch. The driver gathers and sends out half a byte for each. More
#: counters tell list lengths apart better in a larger corpus.
COUNTERS = 1 << 24
#: Counters that are summed together.
BLOCK = 1 << 15
#: Shingles whose counters a task sorts at once.
SORTED = 1 << 20
#: Longest list whose members are paired.
SHORT = 32
#: Most slices of the shingles, and postings from which there is another one.
SLICES, SLICE_ROWS = 4, 1 << 23
#: Shingles of a block of a group; two blocks are in memory at once.
BLOCK_SHINGLES = 1 << 20
#: Weight of the length of the longest list when choosing how many lists to probe.
MU = 0.01


def _sets(texts: Texts, k: int):
    """The sorted shingle hashes of each row; fewer than ``k`` words are one shingle."""
    words = HASH.words(texts.data, texts.starts, texts.ends)
    runs = HASH.runs(words, k)
    for i in range(texts.rows):
        a, b = int(texts.bounds[i]), int(texts.bounds[i + 1])
        if b - a >= k:
            yield texts.first_row + i, np.unique(runs[a : b - k + 1])
        elif b > a:
            yield texts.first_row + i, HASH.runs(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield texts.first_row + i, np.zeros(0, dtype=np.uint64)


def _needed(n: int, percent: int) -> int:
    """Common shingles without which no partner of a set of ``n`` is similar enough."""
    return -(-n * percent // 100)


def _spare(n: int) -> int:
    """Lists of a set of ``n`` beyond the fewest, which as many must be common."""
    return max(1, n // 20)


def _gaps(cells: np.ndarray, size: int):
    """(block, bytes) of sorted counters, ``size`` to a block: the steps from one to the next.

    A byte of 255 adds to the step that follows.
    """
    block, place = cells // size, cells % size
    first = np.concatenate(([True], block[1:] != block[:-1]))
    gaps = np.where(first, place, np.diff(place, prepend=0))
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(int(ends[-1]), 255, dtype=np.uint8)
    out[ends - 1] = gaps % 255
    begin = np.flatnonzero(first)
    bounds = np.concatenate(([0], ends[begin[1:] - 1], ends[-1:]))
    for i, number in enumerate(block[begin].tolist()):
        yield number, out[bounds[i] : bounds[i + 1]].tobytes()


def _count_gaps(gaps: bytes, size: int) -> np.ndarray:
    """How often each counter of a block comes in what ``_gaps`` made."""
    steps = np.frombuffer(gaps, dtype=np.uint8)
    return np.bincount(np.cumsum(steps, dtype=np.int64)[steps != 255], minlength=size)


def _levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """0 to 15 by how far a counter is above the ``mean``, which is what rare shingles make up."""
    low = [max(mean + x * math.sqrt(mean), i + 1.5) for i, x in enumerate((-2, -1.5, -1, -0.5, 0, 0.5, 1, 2, 3))]
    return np.searchsorted(low + [low[-1] + 4**i * 32 for i in range(6)], counts).astype(np.uint8)


def _count_shingles(k: int, counters: int):
    def found(shingles):
        cells = np.sort((np.concatenate(shingles) & np.uint64(counters - 1)).astype(np.uint32)).astype(np.int64)
        rows = list(_gaps(cells, min(BLOCK, counters))) if len(cells) else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["block", "cells"])

    def count(batches):
        shingles, n = [], 0
        for batch in batches:
            for texts in scan(batch.column(0), lower=True):
                shingles += [s for _, s in _sets(texts, k)]
                n += len(texts.starts)
                if n >= SORTED:
                    yield found(shingles)
                    shingles, n = [], 0
        if shingles:
            yield found(shingles)

    return count


def _add_counts(counters: int, mean: float):
    size = min(BLOCK, counters)

    def add(key, table):
        total = np.zeros(size, dtype=np.int64)
        for cells in table.column("cells"):
            total += _count_gaps(cells.as_py(), size)
        levels = _levels(total, mean)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": [(levels[::2] | levels[1::2] << 4).tobytes()]})

    return add


def list_lengths(docs: DataFrame, k: int, total: int, counters: int = COUNTERS) -> np.ndarray:
    """In how many documents shingles of each counter lie, on a scale of 0 to 15, two in a byte.

    ``total`` is the number of shingles of all documents.
    """
    kind = "block int, cells binary"
    parts = docs.select("text").mapInArrow(_count_shingles(k, counters), kind)
    # As a table, because Spark keeps the shuffle files of what is collected for longer.
    parts = stored(parts.groupBy("block").applyInArrow(_add_counts(counters, total / counters), kind))
    packed = np.zeros(counters // 2, dtype=np.uint8)
    size = min(BLOCK, counters) // 2
    for row in parts.collect():
        packed[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["cells"], dtype=np.uint8)
    dropped(parts)
    return packed


def _heads(k: int):
    def heads(batches):
        for batch in batches:
            rows, n, a, b = [], [], [], []
            for texts in scan(batch.column("text"), lower=True):
                for row, shingles in _sets(texts, k):
                    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                    rows.append(row)
                    n.append(len(shingles))
                    a.append(int.from_bytes(digest[:8], "big", signed=True))
                    b.append(int.from_bytes(digest[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (n, a, b)],
                names=["doc_id", "n", "fa", "fb"],
            )

    return heads


def _post(k: int, percent: int, lengths):
    def post(batches):
        packed = lengths.value
        last = np.uint64(2 * len(packed) - 1)
        for batch in batches:
            for texts in scan(batch.column("text"), lower=True):
                rows, keys, sizes = [], [], []
                for row, shingles in _sets(texts, k):
                    n = len(shingles)
                    if not n:
                        continue
                    cell = (shingles & last).astype(np.int64)
                    level = packed[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8) & 15
                    posted = min(n, n - _needed(n, percent) + _spare(n))
                    keys.append(shingles[np.argsort(level, kind="stable")[:posted]])
                    rows += [row] * posted
                    sizes += [n] * posted
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate(keys))), batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64())],
                        names=["h", "doc_id", "n"],
                    )

    return post


class _Parts:
    """Union-find over the documents of a block."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def search(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int):
    """Links between sets marked ``left`` and ``right`` that join two parts.

    Yields (i, j). Exact: all similar pairs of a left and a right set are connected by
    what is yielded.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    _, list_of, length = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(m), sizes)[np.argsort(list_of, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(length)))
    longest = math.log(int(length.max()) + 1)
    parts = _Parts(m)
    for q in np.flatnonzero(left):
        n = int(sizes[q])
        if not n:
            continue
        lists = list_of[bounds[q] : bounds[q + 1]]
        by_length = np.argsort(length[lists], kind="stable")
        needed = _needed(n, percent)
        probed = min(needed - 1, int(needed / (MU * longest + 1)))
        merged, rest = by_length[: n - probed], by_length[n - probed :]
        shortest = lists[merged]
        shortest = shortest[length[shortest] > 1]
        if not len(shortest):
            continue
        met = np.concatenate([owners[begin[x] : begin[x + 1]] for x in shortest])
        # Each list names a document once, so this merges the lists by document.
        who, common = np.unique(met, return_counts=True)
        both_ways = left[who] & right[q]
        fit = right[who] & (common >= needed - probed) & (who != q) & (~both_ways | (who > q))
        fit &= (100 * np.minimum(sizes[who], n) >= percent * np.maximum(sizes[who], n))
        long_keys = sets[q][rest]
        for c, count in sorted(zip(who[fit].tolist(), common[fit].tolist()), key=lambda x: -x[1]):
            if parts.root(c) == parts.root(q):
                continue
            other = sets[c]
            at = np.searchsorted(other, long_keys)
            at[at == len(other)] = 0
            overlap = count + int((other[at] == long_keys).sum())
            if 100 * overlap >= percent * (n + len(other) - overlap) and parts.join(q, c):
                yield q, c


def _search_groups(k: int, percent: int):
    """Rows sorted by (g, i, j), one block or pair of blocks after the other."""

    def found(key, rows):
        if len(rows) < 2:
            return []
        sets, block = [x[1] for x in rows], np.array([x[2] for x in rows])
        return [(rows[a][0], rows[b][0]) for a, b in search(sets, block == key[1], block == key[2], percent)]

    def groups(batches):
        key, rows = None, []
        for batch in batches:
            links = []
            turns = list(zip(*[batch.column(c).to_pylist() for c in ("g", "i", "j")]))
            doc_id, block = batch.column("doc_id").to_pylist(), batch.column("block").to_pylist()
            for texts in scan(batch.column("text"), lower=True):
                for row, shingles in _sets(texts, k):
                    if key != turns[row]:
                        links += found(key, rows)
                        key, rows = turns[row], []
                    rows.append((doc_id[row], shingles, block[row]))
            yield _edges(links)
        yield _edges(found(key, rows))

    def _edges(links):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return groups


def candidate_links(postings: DataFrame, percent: int, slices: int = 1) -> DataFrame:
    """(a, b) whose components hold every pair that can be similar enough, as a table."""
    pairs, chained = [], []
    for i in range(slices):
        part = postings.where(F.pmod("h", F.lit(slices)) == i)
        length = part.groupBy("h").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m > 1")
        lists = stored(part.join(length, "h"))
        short = lists.where(F.col("m") <= SHORT).select("h", "doc_id", "n")
        other = short.select("h", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
        both = short.withColumnRenamed("doc_id", "a").join(other, "h")
        both = both.where((F.col("a") > F.col("b")) & (F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent))
        pairs.append(stored(both.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("n").alias("n"), F.min("nb").alias("nb"))))
        far = lists.where((F.col("m") > SHORT) & (F.col("doc_id") != F.col("first")))
        chained.append(stored(far.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()))
        dropped(lists)
    spare = F.greatest(F.lit(1), F.floor(F.least("n", "nb") / 20))
    met = reduce(DataFrame.union, pairs).groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("n").alias("n"), F.min("nb").alias("nb"))
    links = stored(reduce(DataFrame.union, chained, met.where(F.col("common") >= spare).select("a", "b")))
    dropped(*pairs, *chained)
    return links


def _dealt(salt: int, blocks):
    """A block for each document, of ``blocks`` by a hash that goes with ``salt``."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), blocks).cast("int")


def _alone(groups: DataFrame, salt: int) -> DataFrame:
    """Turns in which each block of a group (doc_id, g, blocks) is searched alone."""
    block = groups.select("doc_id", "g", _dealt(salt, F.col("blocks")).alias("block"))
    return block.select("*", F.col("block").alias("i"), F.col("block").alias("j"))


def _across(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Turns for what ``links`` leave open in groups (doc_id, g, n): all but the largest part with itself."""
    parts = components(links)
    parts = groups.join(parts, F.col("doc_id") == F.col("node"), "left").select("doc_id", "g", "n", F.coalesce("component", "doc_id").alias("part"))
    parts = stored(parts)
    mass = parts.groupBy("g", "part").agg(F.sum("n").alias("n")).groupBy("g")
    mass = mass.agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n"))
    inner, outer = (F.ceil(x / BLOCK_SHINGLES).cast("int") for x in (F.col("main.n"), F.col("n") - F.col("main.n")))
    mass = mass.select("g", F.col("main.part").alias("main"), inner.alias("inner"), outer.alias("outer")).where("outer > 0")
    rows = parts.join(mass, "g")
    main, last = F.col("part") == F.col("main"), F.col("inner") + F.col("outer") - 1
    block = F.when(main, _dealt(2, F.col("inner"))).otherwise(F.col("inner") + _dealt(2, F.col("outer")))
    other = F.explode(F.sequence(F.when(main, F.col("inner")).otherwise(0), last))
    rows = rows.select("doc_id", "g", block.alias("block"), other.alias("other"))
    return rows.select("doc_id", "g", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _linked(docs: DataFrame, turns: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that the turns (doc_id, g, block, i, j) find, as a table.

    Texts are dealt out, as they take less room than their shingles.
    """
    turns = stored(turns)
    wanted = key_filter(turns, "doc_id", turns.count())
    # As many turns as there are copies, so they are never broadcast, however few here.
    rows = docs.where(wanted(F.col("doc_id"))).join(turns.hint("merge"), "doc_id")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    links = stored(rows.mapInArrow(_search_groups(k, percent), "a long, b long"))
    dropped(turns)
    return links


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, counters: int = COUNTERS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text, ...).

    A-Z are lower-cased and a document is the set of its distinct ``k``-word shingles; of
    fewer words, the whole sequence is one shingle. Two documents are linked when
    100 * |intersection| >= ``percent`` * |union|, and component_id is the smallest doc_id
    reachable by links, itself included.

    Null and empty texts, and texts without words, have no shingles and no links. Rows
    that share a doc_id are one document with several texts, so they share a component. A
    null doc_id gets a null component and links nothing. An empty table gives an empty
    result; other columns are ignored. ``counters`` must be a power of two.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = stored(docs.mapInArrow(_heads(k), "doc_id long, n long, fa long, fb long"))
    known = heads.where("n > 0 and doc_id is not null")
    first = known.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"))
    copies = known.join(first, ["fa", "fb"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    reps = stored(first.select(F.col("rep").alias("doc_id")).distinct())

    total = heads.agg(F.sum("n")).first()[0] or 0
    lengths = spark.sparkContext.broadcast(list_lengths(docs, k, total, counters))
    # What the filter lets through besides the first of copies is linked to it all the same.
    wanted = key_filter(reps, "doc_id", reps.count())
    postings = docs.where(F.col("doc_id").isNotNull() & wanted(F.col("doc_id")))
    postings = stored(postings.mapInArrow(_post(k, percent, lengths), "h long, doc_id long, n long"))
    posted = total * (105 - percent) // 100
    links = candidate_links(postings, percent, min(SLICES, 1 + posted // SLICE_ROWS))
    dropped(postings, reps)
    groups = components(links)
    dropped(links)
    groups = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("g"))
    groups = stored(groups.join(known.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id"))
    blocks = groups.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    groups = groups.join(blocks, "g")
    found = _linked(docs, _alone(groups, 0), k, percent)
    large = stored(groups.where("blocks > 1"))
    if large.head(1):
        found = found.union(_linked(docs, _alone(large, 1), k, percent))
        found = found.union(_linked(docs, _across(large, found), k, percent))
    joined = components(found.union(copies))
    out = heads.join(joined, heads["doc_id"] == joined["node"], "left")
    return out.select(
        heads["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("component", heads["doc_id"]).alias("component_id")
    )


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` (doc_id, text, ...) for each group of similar documents.

    Rows that share a doc_id but not the text are documents of their own: the join knows
    them by a hash of both. Of a group stays that with the smallest doc_id, of several with
    that doc_id one of them, and of equal rows one. Texts without words are similar to
    nothing and rows without a doc_id are not compared: all of them stay. All columns are
    kept, an empty table gives an empty result.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    reused = stored(ids.where("n > 1").select(F.col("doc_id").alias("sim__reused")))
    own = docs.where("doc_id is not null").join(reused, F.col("doc_id") == F.col("sim__reused"), "left")
    key = F.when(F.col("sim__reused").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    own = own.withColumn("sim__key", key).drop("sim__reused")
    groups = similar_documents(own.select(F.col("sim__key").alias("doc_id"), "text"), k, percent)
    groups = stored(groups.groupBy(F.col("doc_id").alias("key")).agg(F.max("n_shingles").alias("n"), F.max("component_id").alias("part")))
    named = own.select("doc_id", "sim__key").distinct().join(groups.hint("merge"), F.col("sim__key") == F.col("key"))
    first = named.groupBy("part").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key"), F.max("n").alias("n"))
    kept = first.select(F.col("key").alias("sim__kept"), F.col("n").alias("sim__n"))
    met = own.join(kept.hint("merge"), F.col("sim__key") == F.col("sim__kept"))
    place = F.row_number().over(Window.partitionBy("sim__key").orderBy("doc_id"))
    out = met.withColumn("sim__place", place).where("sim__place = 1 or sim__n = 0").select(*docs.columns)
    return out.union(docs.where("doc_id is null"))

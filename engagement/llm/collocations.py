"""Collocations: phrases of two to four words that occur more often than their parts explain.

Counts are kept as sorted streams, after the external layout in which n-gram models are
estimated (Heafield et al. 2013). Tasks count the phrases of blocks of text and put out
runs in prefix order, one for each bucket of phrases; a bucket's runs are added up in one
place. First come words and pairs of words. Longer phrases are counted only where all
their pairs are frequent, as a phrase is no more frequent than any part of it: a bitmap of
fixed size tells most infrequent pairs, and lets pairs through that share a bit with a
frequent one, which costs some counting and changes no result. The streams of frequent
phrases are then joined by merging, in prefix order to learn the counts of left parts and
of right-hand extensions, and in suffix order for right parts and left-hand extensions.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, stored
from .ship import ship
from .words import mix

#: Bytes of text counted together; a piece is never cut, so a longer piece makes more.
BLOCK = 4 << 20
#: Bytes of text for each task that adds up counts.
BUCKET = 16 << 20
#: Bits of the map of frequent pairs: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Parts of a language's phrases that are ranked on their own first.
SALTS = 64
#: The longest phrases.
LONGEST = 4

#: What parts words, and what parts pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_STEP = np.uint64(0x9FB21C651E98DF25)


def blocks(texts):
    """The texts, each ended by a line break, in blocks cut between pieces."""
    group, size = [], 0
    for text in texts:
        at = 0
        while at < len(text):
            cut = None if len(text) - at <= BLOCK else _BREAK.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            group.append(text[at:end])
            size += end - at + 1
            at = end
            if size >= BLOCK:
                yield b"\n".join(group) + b"\n"
                group, size = [], 0
    if group:
        yield b"\n".join(group) + b"\n"


class Phrases:
    """The words of a block as numbers in byte order, and its phrases level by level."""

    def __init__(self, block: bytes, lang: str):
        data = np.frombuffer(block, dtype=np.uint8)
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
        kind = _KIND[data]
        gap = kind > 0
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        ends = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
        self.piece = np.cumsum(kind == 2)[starts]
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~gap])])
        words = words.dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.vocabulary = words.dictionary.take(pa.array(order))
        self.codes = place[words.indices.to_numpy()] if len(starts) else np.zeros(0, dtype=np.int64)
        seed = xxhash.xxh64_intdigest(lang)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary.to_pylist()], dtype=np.uint64)

    def words(self):
        """(word numbers, hashes, counts) of the single words."""
        counts = np.bincount(self.codes, minlength=len(self.vocabulary))
        return np.arange(len(self.vocabulary))[:, None], self.hashes, counts

    def extend(self, at, rank, grams, hashes):
        """The next level: phrases at the positions ``at`` with one more word each.

        ``rank`` numbers the phrase at each position by its row in ``grams`` and ``hashes``.
        Numbers follow prefix order, as those of the words do.
        """
        size = max(1, len(self.vocabulary))
        key = rank * size + self.codes[at + grams.shape[1]]
        keys, ranks, counts = np.unique(key, return_inverse=True, return_counts=True)
        before, last = keys // size, keys % size
        longer = np.concatenate((grams[before], last[:, None]), axis=1)
        return ranks, longer, mix(hashes[before] * _STEP + self.hashes[last]), counts

    def inside(self, n: int) -> np.ndarray:
        """Positions from which ``n`` words lie in one piece."""
        if len(self.piece) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])

    def lines(self, grams) -> pa.Array:
        """The phrases, words joined by a space, each ended by a line break."""
        columns = [self.vocabulary.take(pa.array(grams[:, i])) for i in range(grams.shape[1])]
        space, line = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"\n", pa.large_binary())
        text = pc.binary_join_element_wise(*columns, space) if len(columns) > 1 else columns[0]
        return pc.binary_join_element_wise(text, pa.scalar(b"", pa.large_binary()), line)


def pair_hash(phrase: bytes, lang: str) -> int:
    """The hash by which ``Phrases`` knows a pair of words."""
    seed = xxhash.xxh64_intdigest(lang)
    a, b = (np.array([xxhash.xxh64_intdigest(w, seed)], dtype=np.uint64) for w in phrase.split(b" "))
    return int(mix(a * _STEP + b)[0])


def _levels(phrases: Phrases, frequent):
    """(length, grams, hashes, counts): words and pairs, or what is longer if ``frequent`` is given."""
    grams, hashes, counts = phrases.words()
    if frequent is None:
        yield 1, grams, hashes, counts
    at = phrases.inside(2)
    rank, grams, hashes, counts = phrases.extend(at, phrases.codes[at], grams, hashes)
    if frequent is None:
        yield 2, grams, hashes, counts
        return
    bit = hashes & np.uint64(FILTER_BITS - 1)
    often = (frequent[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
    good = np.zeros(len(phrases.codes) + 1, dtype=bool)
    good[at] = often[rank]
    ranks = np.full(len(phrases.codes), -1, dtype=np.int64)
    ranks[at] = rank
    for n in range(3, LONGEST + 1):
        at = phrases.inside(n)
        keep = ranks[at] >= 0
        for i in range(n - 1):
            keep &= good[at + i]
        at = at[keep]
        rank, grams, hashes, counts = phrases.extend(at, ranks[at], grams, hashes)
        yield n, grams, hashes, counts
        ranks = np.full(len(phrases.codes), -1, dtype=np.int64)
        ranks[at] = rank


RUN = "bucket int, lang string, words int, phrases binary, counts binary"


def _runs(buckets: int, filtered=None):
    """Sorted runs of phrases with their counts, by language, length and bucket."""

    def runs(batches):
        frequent = None if filtered is None else filtered.value
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").cast(pa.large_binary())
            for lang in dict.fromkeys(langs):
                own = texts.take(pa.array(np.flatnonzero(langs == lang)))
                for block in blocks(t.as_py() or b"" for t in own):
                    out = []
                    phrases = Phrases(block, lang)
                    if frequent is None:
                        total = np.array([len(phrases.codes)], dtype=np.int64)
                        out.append((0, lang, 0, b"\n", total.tobytes()))
                    for n, grams, hashes, counts in _levels(phrases, frequent):
                        bucket = (hashes >> np.uint64(32)).astype(np.int64) % buckets
                        order = np.argsort(bucket, kind="stable")
                        bucket, counts = bucket[order], counts[order].astype(np.int64)
                        lines = phrases.lines(grams[order])
                        offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64, count=len(lines) + 1) if len(lines) else np.zeros(1, dtype=np.int64)
                        data = memoryview(lines.buffers()[2]) if len(lines) else memoryview(b"")
                        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(lines) else []
                        for lo, hi in zip(edges[:-1], edges[1:]):
                            run = bytes(data[offsets[lo] : offsets[hi]])
                            out.append((int(bucket[lo]), lang, n, run, counts[lo:hi].tobytes()))
                    columns = list(zip(*out)) or [[]] * 5
                    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "lang", "words", "phrases", "counts"]
                    )

    return runs


def _added(runs: list[tuple[bytes, bytes]], least: int):
    """Phrases and counts of several runs, added up; those counted ``least`` times or more."""
    data = np.frombuffer(b"".join(p for p, _ in runs), dtype=np.uint8)
    counts = np.frombuffer(b"".join(c for _, c in runs), dtype=np.int64)
    line = data == 10
    offsets = np.concatenate(([0], np.flatnonzero(line) - np.arange(len(counts))))
    text = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~line])])
    table = pa.table({"phrase": text, "count": pa.array(counts)}).group_by("phrase").aggregate([("count", "sum")])
    return table.filter(pc.greater_equal(table["count_sum"], least))


COUNT = "lang string, words int, phrase string, a long, bit long"


def _add(least: int):
    """Frequent phrases from runs sorted by bucket, language and length."""

    def frequent(lang, words, runs):
        table = _added(runs, least if words else 0)
        phrases = table["phrase"].to_pylist()
        bits = [pair_hash(p, lang) % FILTER_BITS + 1 if words == 2 else None for p in phrases]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(phrases), pa.string()),
                pa.array([words] * len(phrases), pa.int32()),
                pa.array([p.decode() for p in phrases], pa.string()),
                pa.array(table["count_sum"].to_pylist(), pa.int64()),
                pa.array(bits, pa.int64()),
            ],
            names=["lang", "words", "phrase", "a", "bit"],
        )

    def add(batches):
        key, runs = None, []
        for batch in batches:
            for *own, phrases, counts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "lang", "words", "phrases", "counts")]):
                if own != key:
                    if runs:
                        yield frequent(key[1], key[2], runs)
                    key, runs = own, []
                runs.append((phrases, counts))
        if runs:
            yield frequent(key[1], key[2], runs)

    return add


def _counted(texts: DataFrame, buckets: int, least: int, filtered=None) -> DataFrame:
    runs = texts.mapInArrow(_runs(8 * buckets, filtered), RUN)
    # Every run of a bucket comes from another block; a hot phrase is one line in each.
    dealt = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang", "words")
    return stored(dealt.mapInArrow(_add(least), COUNT))


def _pair_filter(pairs: DataFrame) -> np.ndarray:
    """A bit for each frequent pair, set on the executors; ``FILTER_BITS`` in all."""
    bits = pairs.where("words = 2").groupBy(F.bitmap_bucket_number("bit").alias("slot"))
    found = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in found:
        # Spark counts slots and bits from 1; a slot has 4096 bytes.
        first = (row["slot"] - 1) * 4096
        out[first : first + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, words, phrase, a: phrases of up to ``LONGEST`` words counted ``least`` times or more.

    A row with 0 words and an empty phrase holds the number of all words of its language.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    short = _counted(texts, buckets, least)
    filtered = spark.sparkContext.broadcast(_pair_filter(short))
    long = _counted(texts, buckets, least, filtered)
    return short.drop("bit").unionByName(long.drop("bit"))


def mine_collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` collocations of each language.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. A phrase of two to four words found a >= ``least`` times, overlaps
    included, is a candidate. Cut in two parts found l and r times it scores
    floor(2000000 * a / (l + r)); its lowest-scoring cut counts, the first of equal ones. It
    goes if a longer candidate holds it and is found at least ``share`` in 100 of its times:
    one word more suffices to see that, as a phrase between the two is at least as frequent
    as the longer one. n is the number of all words of the language; ranks follow score, a
    and the phrase in byte order.

    A null text counts as empty and a null lang as ``und``; doc_id is not used, and repeated
    rows count each. A text without frequent phrases adds to n only, a language without any
    has no row, an empty table gives an empty result. Pieces are counted whole, so a worker
    holds the longest one. Other columns are ignored.
    """
    counts = frequent_phrases(docs, least)
    totals = counts.where("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    streams = stored(counts.where("words > 0"))
    phrases = streams.where("words > 1")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumns(
        {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")}
    )
    left = streams.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = streams.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    cuts = cuts.join(left.hint("merge"), ["lang", "left"]).join(right.hint("merge"), ["lang", "right"])
    exact = [F.col(c).cast("decimal(20,0)") for c in "alr"]
    cuts = cuts.withColumns({"ea": exact[0] * 2_000_000, "both": exact[1] + exact[2]}).withColumn("score", F.expr("ea div both"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    inner = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = scored.join(longer.hint("merge"), ["lang", "phrase"], "left")
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    kept = met.where(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "a", "low.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    found = stored(
        kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
    dropped(counts, streams)
    return found

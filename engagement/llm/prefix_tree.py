"""Conversations as packed prefix trees: turns that several of them begin with come once.

A node is a turn together with all turns before it, known by a digest that is chained from
turn to turn, so equal beginnings meet in one aggregation. The nodes of one first turn are a
tree. Its tokens are put out depth-first: each node has its place in the tree's token
sequence, the position id of its first token (the tokens before it on its path), and the
intervals of the sequence that it may attend to (those of its ancestors, and itself).

Depth-first order comes from a sort, not from a walk: a node's key is the chain of digests
at which its path leaves a fork, and nodes lie by key, then depth. Where nothing forks the
key does not grow, so it costs 16 bytes a fork, and the intervals of a whole run of nodes
are one. Places are sums within range partitions plus the sums of the partitions before, so
a tree that a third of all conversations share is spread over many tasks.
"""

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, stored
from .ship import ship

#: The template's own marks, and control strings of other templates.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: All of these, after their first character; a backslash in between makes them plain text.
REST = r"\|im_(?:start|sep|end)\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>"
LEARNED = "assistant"
_PLAIN = re.compile(rf"([<\[])(\\*)({REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({REST})")
_BLANK = re.compile(r"\s{500,}")


def escape(text: str) -> str:
    """``text`` without control strings; ``unescape`` brings it back.

    A control string gets a backslash after its first character, and one with backslashes
    there already gets one more. No control string starts within the rest of another one.
    """
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary: a file of ranks, which every executor has at that place, and
    the pattern that cuts texts into what is merged."""

    path: str
    pattern: str


class Template:
    """Turns to tokens and back; the three marks are ids beyond the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        with open(vocabulary.path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.start, self.middle, self.end = first, first + 1, first + 2
        #: Tokens are stored as little-endian unsigned integers of this kind.
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def tokens(self, text: str) -> list[int]:
        """The library's pattern recurses over long white space, so that is merged apart."""
        out, at = [], 0
        for blank in _BLANK.finditer(text):
            # The last one belongs to what follows.
            end = blank.end() - (blank.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : blank.start()])
            out += self.encoding._encode_single_piece(text[blank.start() : end].encode())
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def encode(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Tokens of a turn, and from where to where they are learned."""
        head, body = self.tokens(escape(role)), self.tokens(escape(text))
        first = len(head) + 2
        tokens = np.array([self.start, *head, self.middle, *body, self.end], dtype=self.kind)
        return tokens, first, first + len(body) if role == LEARNED else first

    def text(self, tokens: np.ndarray) -> str:
        return self.encoding.decode_bytes(tokens.tolist()).decode()

    def decode(self, tokens: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn, as they stand in the output."""
        middle = int((tokens == self.middle).argmax())
        return self.text(tokens[1:middle]), self.text(tokens[middle + 1 : -1])


@lru_cache(maxsize=2)
def _template(vocabulary: Vocabulary) -> Template:
    return Template(vocabulary)


def _rows(batches, names):
    for batch in batches:
        yield from zip(*[batch.column(name).to_pylist() for name in names])


def _sent(rows, schema: pa.Schema, size: int = 2048):
    """Rows in record batches; texts and tokens are long, so batches are small."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    columns = list(zip(*out)) or [[]] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


CHAIN = pa.schema([("conv_id", pa.int64()), ("place", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("role", pa.string()), ("text", pa.string())])


def _chain(batches):
    """Digests of rows sorted by conversation and turn; holds one row at a time."""

    def chained():
        conv, place, parent = object(), 0, None
        for conv_id, role, text in _rows(batches, ("conv_id", "role", "text")):
            if conv_id != conv:
                conv, place, parent = conv_id, 0, None
            name = role.encode()
            digest = hashlib.blake2b(parent or b"", digest_size=16)
            digest.update(b"%d:" % len(name) + name)
            digest.update(text.encode())
            node = digest.digest()
            yield conv_id, place, node, parent, role, text
            place, parent = place + 1, node

    yield from _sent(chained(), CHAIN)


NODE = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("n_tokens", pa.int64()), ("loss_first", pa.int32()), ("loss_last", pa.int32()), ("tokens", pa.binary())])


def _tokenize(vocabulary: Vocabulary):
    def tokenize(batches):
        template = _template(vocabulary)

        def nodes():
            for node, parent, depth, role, text in _rows(batches, ("node", "parent", "depth", "role", "text")):
                tokens, first, last = template.encode(role, text)
                yield node, parent, depth, len(tokens), first, last, tokens.tobytes()

        yield from _sent(nodes(), NODE)

    return tokenize


PATH = pa.schema([("node", pa.binary()), ("key", pa.binary()), ("position", pa.int64())])


def _paths(batches):
    """Key and position of each turn of rows sorted by conversation and place."""

    def paths():
        key, position = b"", 0
        for place, node, n_tokens, forked in _rows(batches, ("place", "node", "n_tokens", "forked")):
            if place == 0:
                key, position = b"", 0
            if forked or place == 0:
                key += node
            yield node, key, position
            position += n_tokens

    yield from _sent(paths(), PATH)


BEFORE = pa.schema([("node", pa.binary()), ("key", pa.binary()), ("depth", pa.int32()), ("position", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int32()), ("before", pa.int64())])


def _before(batches):
    """Tokens of the sorted rows before each one in its partition."""

    def rows():
        before = 0
        for row in _rows(batches, ("node", "key", "depth", "position", "n_tokens", "part")):
            yield *row, before
            before += row[4]

    yield from _sent(rows(), BEFORE)


def _depth_first(nodes: DataFrame) -> DataFrame:
    """node, key, depth, position, tree, offset: places in the token sequences of the trees."""
    ranged = nodes.repartitionByRange("key", "depth").sortWithinPartitions("key", "depth")
    ranged = ranged.select("node", "key", "depth", "position", "n_tokens", F.spark_partition_id().alias("part"))
    placed = stored(ranged.mapInArrow(_before, "node binary, key binary, depth int, position long, n_tokens long, part int, before long"))
    # One row for each partition.
    parts = placed.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    placed = placed.join(parts, "part").withColumn("at", F.col("base") + F.col("before"))
    placed = placed.withColumn("tree", F.substring("key", 1, 16))
    roots = placed.where("depth = 0").select("tree", F.col("at").alias("root"))
    return placed.join(roots, "tree").select(
        "node", "key", "depth", "position", "n_tokens", F.lower(F.hex("tree")).alias("tree"), (F.col("at") - F.col("root")).alias("offset")
    )


def _ancestors(placed: DataFrame) -> DataFrame:
    """key, first and the intervals of all runs before it on the path, adjacent ones joined.

    A run is the nodes of one key, which lie one after the other; a path leaves a run at
    its last node only.
    """
    last = F.max(F.col("offset") + F.col("n_tokens")).alias("last")
    runs = stored(placed.groupBy("key").agg(F.min("offset").alias("first"), last))
    prefixes = F.expr("transform(sequence(1, length(key) div 16 - 1), i -> substring(key, 1, 16 * i))")
    inner = runs.where(F.length("key") > 16).select("key", F.explode(prefixes).alias("above"))
    above = runs.select(F.col("key").alias("above"), F.struct("first", "last").alias("run"))
    met = inner.join(above, "above").groupBy("key").agg(F.sort_array(F.collect_list("run")).alias("path"))
    joined = F.expr("""
        aggregate(path, cast(array() as array<struct<first: bigint, last: bigint>>), (done, run) ->
            if(size(done) > 0 and element_at(done, -1).last = run.first,
                concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).first as first, run.last as last))),
                concat(done, array(run))))""")
    met = met.select("key", joined.alias("path"))
    empty = F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)")
    return runs.join(met, "key", "left").select("key", "first", F.coalesce("path", empty).alias("path"))


@dataclass
class Packed:
    """Trees of conversations, and where each turn lies in them."""

    nodes: DataFrame  #: tree, offset, depth, position, n_tokens, loss_first, loss_last, attend, tokens
    turns: DataFrame  #: conv_id, place, tree, offset


def pack_conversations(conversations: DataFrame, vocabulary: Vocabulary) -> Packed:
    """The conversations (conv_id, turn, role, text, ...) as packed prefix trees.

    ``nodes`` lie by tree and offset, and their tokens one after the other are the tree's
    sequence. ``attend`` has the intervals (first, last, exclusive) of the sequence that a
    node's tokens see, the last one ending with the node itself, inside which attention is
    causal. ``tokens`` are unsigned integers of 16 bits, or of 32 for a vocabulary that needs
    them, in little-endian order. ``loss_first`` to ``loss_last`` (exclusive, within the node) are the tokens of
    an assistant's text. ``turns`` tells for each conversation and its places from 0 which
    node is its turn.

    Rows are taken by turn (nulls first), those of one turn by role and text; repeated rows
    are turns of their own. A null role or text counts as empty, rows with a null conv_id
    are one conversation. Very long texts are one node; a worker holds one conversation's
    running digest and a few turns, not the conversation. An empty table gives empty tables;
    other columns are ignored.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    chain = stored(rows.mapInArrow(_chain, "conv_id long, place int, node binary, parent binary, role string, text string"))
    once = chain.withColumnRenamed("place", "depth").select("node", "parent", "depth", "role", "text").dropDuplicates(["node"])
    kind = "node binary, parent binary, depth int, n_tokens long, loss_first int, loss_last int, tokens binary"
    nodes = stored(once.mapInArrow(_tokenize(vocabulary), kind))
    forks = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"))
    forks = forks.where("children > 1").select(F.col("parent").alias("fork"))
    known = nodes.select("node", "parent", "n_tokens").join(forks, F.col("parent") == F.col("fork"), "left")
    known = known.select("node", "n_tokens", F.col("fork").isNotNull().alias("forked"))
    steps = chain.select("conv_id", "place", "node").join(known, "node")
    steps = steps.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    paths = steps.mapInArrow(_paths, "node binary, key binary, position long")
    paths = paths.groupBy("node").agg(F.max("key").alias("key"), F.max("position").alias("position"))
    measured = stored(paths.join(nodes.select("node", "depth", "n_tokens"), "node"))
    placed = stored(_depth_first(measured))
    above = _ancestors(placed)
    whole = F.struct(F.col("first"), (F.col("offset") + F.col("n_tokens")).alias("last"))
    attend = F.when(
        (F.size("path") > 0) & (F.try_element_at("path", F.lit(-1))["last"] == F.col("first")),
        F.expr("concat(slice(path, 1, size(path) - 1), array(struct(try_element_at(path, -1).first as first, offset + n_tokens as last)))"),
    ).otherwise(F.concat("path", F.array(whole)))
    shown = placed.join(above, "key").select("node", "tree", "offset", "depth", "position", attend.alias("attend"))
    packed = shown.join(nodes.drop("parent", "depth"), "node")
    packed = packed.select("tree", "offset", "depth", "position", "n_tokens", "loss_first", "loss_last", "attend", "tokens")
    packed = stored(packed.repartitionByRange("tree", "offset").sortWithinPartitions("tree", "offset"))
    turns = stored(chain.select("conv_id", "place", "node").join(placed.select("node", "tree", "offset"), "node").drop("node"))
    dropped(chain, nodes, measured, placed)
    return Packed(packed, turns)


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(vocabulary: Vocabulary):
    """Digests of conversations from their tokens, sorted by conversation and place."""

    def read(batches):
        template = _template(vocabulary)
        marks = len(START) + len(MIDDLE) + len(END)

        def conversations():
            own = None
            for conv_id, place, tokens, first, last in _rows(batches, ("conv_id", "place", "tokens", "loss_first", "loss_last")):
                if place == 0:
                    if own:
                        yield own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]
                    own = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                tokens = np.frombuffer(tokens, dtype=template.kind)
                role, text = template.decode(tokens)
                own[1] += 1
                own[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                learned = unescape(template.text(tokens[first:last]))
                own[3] += len(learned)
                own[4].update(learned.encode())
                own[5] += marks + len(role) + len(text)
            if own:
                yield own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]

        yield from _sent(conversations(), READ)

    return read


def read_back(packed: Packed, vocabulary: Vocabulary) -> DataFrame:
    """What the packed trees say of each conversation.

    conv_id, n_turns, turns_sha256 (of role, line break, text, line break for each turn),
    loss_chars and loss_sha256 (of the text under the loss mask, unescaped), formatted_chars
    (of the formatted conversation, marks and escapes included).
    """
    nodes = packed.nodes.select("tree", "offset", "loss_first", "loss_last", "tokens")
    rows = packed.turns.join(nodes, ["tree", "offset"]).drop("tree", "offset")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.mapInArrow(_read(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Near-duplicate vectors by a forest of random-projection trees.

Trees are grown on a bounded sample: each node splits its vectors at the median of a
random projection, and those within a margin of the median go to both sides. The margin is
a share of what two vectors of the least similarity differ by in a random direction, so a
cluster of similar vectors is not cut up: where most vectors would go both ways, the node
stays a leaf, however large. All vectors are sent down every tree; a leaf that holds too
many of them grows a tree of its own, from a sample of its vectors, and so on, until leaves
are bounded or cannot be parted. So leaves do not grow with the table.

Vectors of one leaf are compared exactly, and links are united. A leaf that cannot be parted
and has more than ``BLOCK_BYTES`` of vectors is compared in packed blocks, pair by pair.
Equal vectors are one vector with a weight throughout, and a pair that meets in several
leaves counts in the first of them only. Leaves put out one row for each vector with a link,
never pairs.
"""

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import dropped, stored
from .ship import ship
from .words import mix, signed

#: Vectors on which the trees are grown.
SAMPLE = 16_384
#: Vectors of a large leaf on which its own tree is grown, and how many times the wanted
#: rows a leaf may hold before that.
LEAF_SAMPLE, LARGE = 2048, 8
#: Projections tried to part a node, and how many rows its parts may have for each of its own.
TRIES, SPILLED = 6, 1.3
#: Bytes of the vectors of a leaf that are held and compared in one task.
BLOCK_BYTES = 8 << 20


@dataclass
class Tree:
    """Inner nodes with their direction and bounds; a child below 0 is leaf -1 - child."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    leaves: int

    def walk(self, vectors: np.ndarray):
        """(leaf, rows) of each leaf that some rows reach."""
        todo = [(0 if len(self.low) else -1, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            seen = vectors[rows] @ self.directions[node]
            left, right = self.children[node]
            todo += [(left, rows[seen < self.high[node]]), (right, rows[seen >= self.low[node]])]


def grow(sample: np.ndarray, total: int, leaf_rows: int, margin: float, seed: int) -> Tree:
    """A tree whose leaves should hold about ``leaf_rows`` of ``total`` vectors."""
    random = np.random.default_rng(seed)
    weight = max(1.0, total / max(1, len(sample)))
    directions, low, high, children, leaves = [], [], [], [], 0

    def place(parent, side, value):
        if parent is not None:
            children[parent][side] = value

    todo = [(np.arange(len(sample)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        if len(rows) * weight > leaf_rows and len(rows) >= 16:
            for attempt in range(TRIES):
                direction = random.standard_normal(sample.shape[1])
                seen = sample[rows] @ (direction / np.linalg.norm(direction)).astype(np.float32)
                # First at the median; beside it where a cluster lies there.
                middle = np.quantile(seen, (0.5, 0.35, 0.65)[attempt % 3])
                a, b = middle - margin, middle + margin
                left, right = rows[seen < b], rows[seen >= a]
                # Vectors that no projection parts stay together in one leaf, and a cluster
                # that goes both ways is better parted elsewhere.
                if max(len(left), len(right)) <= 0.75 * len(rows) and len(left) + len(right) <= SPILLED * len(rows):
                    split = direction / np.linalg.norm(direction), a, b, left, right
                    break
        if split is None:
            place(parent, side, -1 - leaves)
            leaves += 1
            continue
        direction, a, b, left, right = split
        node = len(low)
        directions.append(direction.astype(np.float32))
        low.append(a)
        high.append(b)
        children.append([0, 0])
        place(parent, side, node)
        todo += [(left, node, 0), (right, node, 1)]
    dim = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(
        np.array(directions, dtype=np.float32).reshape(len(low), dim), np.array(low), np.array(high),
        np.array(children, dtype=np.int64).reshape(len(low), 2), leaves,
    )


def _usable(batches):
    """Vectors that can link: as bytes, with a 128-bit digest."""
    for batch in batches:
        ids, out = batch.column("vec_id"), {"row": [], "fa": [], "fb": [], "dim": [], "vec": []}
        column = batch.column("embedding")
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        for i in range(len(batch)):
            values = column[i].values
            if values is None or not len(values) or values.null_count or not ids[i].is_valid:
                continue
            vector = values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0.0 becomes 0.0
            if not np.isfinite(vector).all() or not vector.any():
                continue
            digest = hashlib.blake2b(vector.tobytes(), digest_size=16).digest()
            out["row"].append(i)
            out["fa"].append(int.from_bytes(digest[:8], "big", signed=True))
            out["fb"].append(int.from_bytes(digest[8:], "big", signed=True))
            out["dim"].append(len(vector))
            out["vec"].append(vector.tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(out["row"], pa.int64())), pa.array(out["fa"], pa.int64()), pa.array(out["fb"], pa.int64()), pa.array(out["dim"], pa.int32()), pa.array(out["vec"], pa.binary())],
            names=["vec_id", "fa", "fb", "dim", "vec"],
        )


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    return _unit(b"".join(vectors), len(vectors), dim)


def _unit(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * n * dim else np.float64
    out = np.frombuffer(data, dtype=kind).reshape(n, dim).astype(np.float64)
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


NODE = ("fa", "fb", "node", "copies", "dim", "vec")
#: Fills up lists of leaves, behind all names.
NONE = np.iinfo(np.int64).max


def _named(leaves: np.ndarray, parent) -> np.ndarray:
    """64-bit names of leaves: of a tree by number, or of the leaves another one is cut into."""
    return signed(mix(np.array([parent], dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + leaves.astype(np.uint64)))


def _reached(tree: Tree, unit: np.ndarray, parent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, names) of the leaves of one tree that the vectors reach."""
    rows, leaves = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for leaf, reached in tree.walk(unit):
        rows.append(reached)
        leaves.append(np.full(len(reached), leaf))
    return np.concatenate(rows), _named(np.concatenate(leaves), parent)


def _assign(forest):
    """The leaves of each vector, of all trees; lengths without trees are one leaf."""

    def assign(batches):
        trees = forest.value
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), dtype=np.int64)
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if int(dim) in trees:
                    unit = _matrix(part.column("vec").to_pylist(), int(dim)).astype(np.float32)
                    found = [_reached(tree, unit, i) for i, tree in enumerate(trees[int(dim)])]
                    rows, leaves = (np.concatenate(x) for x in zip(*found))
                else:
                    rows, leaves = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
                order = np.lexsort((leaves, rows))
                bounds = np.searchsorted(rows[order], np.arange(len(part) + 1))
                every = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(leaves[order]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("fa", "fb", "dim")], every], names=["fa", "fb", "dim", "leaves"])

    return assign


def _grow_leaf(leaf_rows: int, margins: dict[int, float], leaf_sample: int):
    """A tree for a large leaf from a sample of its vectors; null if it cannot be parted."""

    def grow_leaf(key, table):
        dim, leaf = key[0].as_py(), key[1].as_py()
        unit = _matrix(table.column("vec").to_pylist(), dim).astype(np.float32)
        total = table.column("n")[0].as_py()
        tree = grow(unit[:leaf_sample], total, leaf_rows, margins[dim], leaf % (1 << 63))
        made = pickle.dumps(tree) if tree.leaves > 1 else None
        return pa.table({"dim": pa.array([dim], pa.int32()), "leaf": pa.array([leaf], pa.int64()), "tree": pa.array([made], pa.binary())})

    return grow_leaf


def _cut_leaves(batches):
    """The leaves that take the place of large ones, for rows sorted by (dim, leaf)."""
    known = {}
    for batch in batches:
        leaves = np.array(batch.column("leaf").to_pylist(), dtype=np.int64)
        for leaf in np.unique(leaves):
            part = batch.take(pa.array(np.flatnonzero(leaves == leaf)))
            dim, made = part.column("dim")[0].as_py(), part.column("tree")[0].as_py()
            if (dim, leaf) not in known:
                known = {(dim, leaf): pickle.loads(made)}
            unit = _matrix(part.column("vec").to_pylist(), dim).astype(np.float32)
            rows, names = _reached(known[dim, leaf], unit, int(leaf))
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(taken) for c in ("fa", "fb", "leaf")] + [pa.array(names)], names=["fa", "fb", "leaf", "new"]
            )


def _bounded_leaves(nodes: DataFrame, leaves: DataFrame, leaf_rows: int, margins: dict[int, float]) -> DataFrame:
    """``leaves`` (fa, fb, dim, leaves) with trees grown in leaves that are too large."""
    spark = nodes.sparkSession
    dense = spark.createDataFrame([], "dim int, leaf long")
    while True:
        each = leaves.select("fa", "fb", "dim", F.explode("leaves").alias("leaf"))
        sizes = each.groupBy("dim", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > LARGE * leaf_rows)
        large = stored(sizes.where(F.col("dim").isin(list(margins))).join(dense, ["dim", "leaf"], "left_anti"))
        if large.isEmpty():
            return leaves
        # Rows of large leaves meet their vectors; a hash of both picks each leaf's sample.
        held = each.join(large, ["dim", "leaf"]).join(nodes.select("fa", "fb", "vec"), ["fa", "fb"])
        draw = F.pmod(F.xxhash64("fa", "fb", "leaf"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = held.where(draw < F.lit(1.5 * LEAF_SAMPLE) / F.col("n")).select("dim", "leaf", "n", "vec")
        grown = _grow_leaf(leaf_rows, margins, LEAF_SAMPLE)
        trees = stored(sample.groupBy("dim", "leaf").applyInArrow(grown, "dim int, leaf long, tree binary"))
        parted = trees.where("tree is not null")
        dense = stored(dense.union(large.select("dim", "leaf").join(parted.select("dim", "leaf"), ["dim", "leaf"], "left_anti")))
        rows = held.join(parted, ["dim", "leaf"]).sortWithinPartitions("dim", "leaf")
        new = stored(rows.mapInArrow(_cut_leaves, "fa long, fb long, leaf long, new long"))
        cut = new.groupBy("fa", "fb").agg(F.collect_set("leaf").alias("gone"), F.collect_set("new").alias("new"))
        both = leaves.join(cut, ["fa", "fb"], "left")
        kept = F.array_sort(F.array_union(F.array_except("leaves", "gone"), "new"))
        before = leaves
        leaves = stored(both.select("fa", "fb", "dim", F.when(F.col("gone").isNull(), F.col("leaves")).otherwise(kept).alias("leaves")))
        dropped(before, new, large, trees)


@dataclass
class Block:
    """Vectors of one leaf: (fa, fb, node, copies) of each, their bytes, and all their leaves."""

    heads: np.ndarray
    vectors: bytes
    leaves: np.ndarray

    @staticmethod
    def of(rows: pa.RecordBatch | pa.Table) -> "Block":
        columns = {c: rows.column(c) for c in ("fa", "fb", "node", "copies", "vec", "leaves")}
        columns = {c: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
        sizes = pc.list_value_length(columns["leaves"]).to_numpy(zero_copy_only=False).astype(np.int64)
        leaves = np.full((len(rows), int(sizes.max())), NONE, dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        leaves[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = columns["leaves"].flatten().to_numpy()
        heads = np.stack([columns[c].to_numpy() for c in ("fa", "fb", "node", "copies")], axis=1)
        return Block(heads, b"".join(columns["vec"].to_pylist()), leaves)

    def unit(self, dim: int) -> np.ndarray:
        return _unit(self.vectors, len(self.heads), dim)


def _united(part: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Parts (each by its smallest member) after the links x-y."""
    while True:
        while (part != part[part]).any():
            part = part[part]
        a, b = part[x], part[y]
        differ = a != b
        if not differ.any():
            return part
        np.minimum.at(part, np.maximum(a, b)[differ], np.minimum(a, b)[differ])


def compared(a: Block, b: Block | None, dim: int, leaf: int, least: float):
    """Links of each vector of a block, or across two, that meet in no earlier leaf, and one
    link of each vector to its part: (fa, fb, links, node, node of the part)."""
    unit = a.unit(dim)
    right = unit if b is None else b.unit(dim)
    rough = unit.astype(np.float32), right.astype(np.float32)
    heads = a.heads if b is None else np.concatenate((a.heads, b.heads))
    shift = 0 if b is None else len(unit)
    early = [np.where(x.leaves < leaf, x.leaves, NONE) for x in (a, b or a)]
    links, part, linked = np.zeros(len(heads), dtype=np.int64), np.arange(len(heads)), np.zeros(len(heads), dtype=bool)
    for i in range(0, len(unit), 256):
        for j in range(i if b is None else 0, len(right), 4096):
            # Single precision rules most pairs out, double precision decides.
            p, q = np.nonzero(rough[0][i : i + 256] @ rough[1][j : j + 4096].T >= np.float32(least - 1e-4))
            p, q = p + i, q + j
            if b is None:
                p, q = p[p < q], q[p < q]
            exact = np.concatenate([
                np.einsum("ij,ij->i", unit[p[at : at + (1 << 16)]], right[q[at : at + (1 << 16)]]) for at in range(0, len(p), 1 << 16)
            ] or [np.zeros(0)])
            p, q = p[exact >= least], q[exact >= least]
            for at in range(0, len(p), 1 << 16):
                x, y = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                new, todo = np.ones(len(x), dtype=bool), np.arange(len(x))
                for k in range(early[0].shape[1]):
                    # Lists are sorted; near vectors share most leaves, so few go on.
                    own = early[0][x[todo], k]
                    todo, own = todo[own < NONE], own[own < NONE]
                    if not len(todo):
                        break
                    met = (early[1][y[todo]] == own[:, None]).any(axis=1)
                    new[todo[met]] = False
                    todo = todo[~met]
                links += np.bincount(x[new], heads[y[new] + shift, 3], len(heads)).astype(np.int64)
                links += np.bincount(y[new] + shift, heads[x[new], 3], len(heads)).astype(np.int64)
                linked[x] = linked[y + shift] = True
                part = _united(part, x, y + shift)
    return [(*heads[n, :2].tolist(), int(links[n]), int(heads[n, 2]), int(heads[part[n], 2])) for n in np.flatnonzero(linked).tolist()]


FOUND = pa.schema([("fa", pa.int64()), ("fb", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
PACKED = pa.schema([*FOUND, ("dim", pa.int32()), ("leaf", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("packed", pa.binary())])


def _leaves(least: float):
    """Rows sorted by (dim, leaf, block): links of whole leaves; blocks of others, packed."""

    def settle(key, rows):
        dim, leaf, block, blocks = key
        made = Block.of(pa.Table.from_batches(rows))
        if blocks == 1:
            return [(*x, None, None, None, None, None) for x in compared(made, None, dim, leaf, least)] if len(made.heads) > 1 else []
        return [(None, None, None, None, None, dim, leaf, block, blocks, pickle.dumps(made))]

    def leaves(batches):
        key, rows = None, []
        for batch in batches:
            if not len(batch):
                continue
            out = []
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "leaf", "block", "blocks")], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))).tolist()
            for lo, hi in zip(edges, [*edges[1:], len(batch)]):
                own = tuple(keys[lo].tolist())
                if own != key:
                    out += settle(key, rows) if rows else []
                    key, rows = own, []
                rows.append(batch.slice(lo, hi - lo))
            yield _table(out, PACKED)
        yield _table(settle(key, rows) if rows else [], PACKED)

    return leaves


def _table(rows, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _across(least: float):
    """Pairs of packed blocks, one after the other."""

    def across(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = pickle.loads(row["packed"])
                b = None if row["other"] is None else pickle.loads(row["other"])
                yield _table(compared(a, b, row["dim"], row["leaf"], least), FOUND)

    return across


def near_vectors(
    vectors: DataFrame, least: float = 0.95, trees: int = 8, leaf_rows: int = 512, spill: float = 0.5, sample: int = SAMPLE
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, ...).

    Two vectors of the same length are linked if their cosine, in double precision, is
    ``least`` or more; n_links counts the other vectors linked directly, component_id is
    the smallest vec_id reachable by links, itself included, and kept tells whether that
    is the vector's own. Links below ``least`` are never made; a link is missed only if
    its two vectors share no leaf of any tree (none is, in a table of up to ``leaf_rows``
    different vectors of one length).

    Vectors that are null, empty or zero, hold null or non-finite components, or have a
    null vec_id link with nothing and are kept. Repeated rows are one vector; rows that
    share a vec_id but differ are in one component and all show the largest n_links. An empty table gives
    an empty result; other columns, labels included, are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)["embedding"]
    numbers = "array<float>" if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(numbers).alias("embedding"))
    usable = stored(rows.mapInArrow(_usable, "vec_id long, fa long, fb long, dim int, vec binary"))
    keys = usable.select("vec_id", "fa", "fb").distinct()
    weights = stored(keys.groupBy("fa", "fb").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    # The copies of a vector hold the same bytes: the row of the smallest vec_id stands for all.
    own = usable.join(weights, ["fa", "fb"]).where("vec_id = node").select(*NODE)
    nodes = stored(own.dropDuplicates(["fa", "fb"]))
    forest, margins = {}, {}
    for size in nodes.groupBy("dim").count().where(F.col("count") > leaf_rows).collect():
        chosen = nodes.where(F.col("dim") == size["dim"]).orderBy(F.xxhash64("fa", "fb"), "fa", "fb").limit(sample)
        taken = [bytes(r["vec"]) for r in chosen.select("vec").collect()]
        unit = _matrix(taken, size["dim"]).astype(np.float32)
        margins[size["dim"]] = spill * (max(0.0, 2 - 2 * least) / size["dim"]) ** 0.5
        forest[size["dim"]] = [grow(unit, size["count"], leaf_rows, margins[size["dim"]], seed) for seed in range(trees)]
    shared = spark.sparkContext.broadcast(forest)
    leaves = stored(nodes.mapInArrow(_assign(shared), "fa long, fb long, dim int, leaves array<long>"))
    leaves = _bounded_leaves(nodes, leaves, leaf_rows, margins)
    each = leaves.select("dim", F.explode("leaves").alias("leaf"))
    room = F.lit(float(BLOCK_BYTES)) / (F.col("dim") * 4)
    sizes = each.groupBy("dim", "leaf").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / room).cast("int"))
    many = stored(sizes.where("blocks > 1").select("dim", "leaf", "blocks"))
    placed = nodes.join(leaves.drop("dim"), ["fa", "fb"]).withColumn("leaf", F.explode("leaves")).join(many, ["dim", "leaf"], "left")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fa", "fb"), "blocks").cast("int"))
    key = ["dim", "leaf", "block"]
    placed = placed.repartition(*key).sortWithinPartitions(*key)
    kinds = "fa long, fb long, links long, a long, b long"
    packed = stored(placed.mapInArrow(_leaves(least), f"{kinds}, dim int, leaf long, block int, blocks int, packed binary"))
    blocks = packed.where("packed is not null").select("dim", "leaf", "block", "blocks", "packed")
    # A block meets itself and the later ones; a pair of blocks is one row.
    others = blocks.select("dim", "leaf", F.col("block").alias("later"), F.col("packed").alias("other"))
    turns = blocks.withColumn("later", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    turns = turns.repartition("dim", "leaf", "block", "later").join(others.hint("merge"), ["dim", "leaf", "later"])
    turns = turns.withColumn("other", F.when(F.col("block") < F.col("later"), F.col("other")))
    across = turns.select("dim", "leaf", "packed", "other").mapInArrow(_across(least), kinds)
    found = stored(packed.where("packed is null").select("fa", "fb", "links", "a", "b").union(across))
    dropped(packed, many, nodes, leaves)
    links = found.groupBy("fa", "fb").agg(F.sum("links").alias("links"))
    same_id = keys.groupBy("fa", "fb").agg(F.min("vec_id").alias("b"))
    copies = keys.join(same_id, ["fa", "fb"]).select(F.col("vec_id").alias("a"), "b")
    parts = components(found.select("a", "b").union(copies))
    counted = weights.join(links, ["fa", "fb"], "left").select(
        "fa", "fb", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    counted = keys.join(counted, ["fa", "fb"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    counted = counted.join(parts, counted["vec_id"] == parts["node"], "left").select("vec_id", "n_links", "component")
    counted = counted.withColumnRenamed("vec_id", "id")
    out = rows.select("vec_id").join(counted, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )

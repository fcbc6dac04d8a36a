"""Rows that wait for each other: groups of them, and small groups settled in one pass.

Rows that want one key depend on each other, and through them rows that share nothing. A
group of such rows is a component of the graph of rows and keys. A small group is decided
by walking its rows in order, as one native fold over a bounded array; a group beyond
``FOLD`` entries, such as that of a key a third of all rows want, is left to rounds over
the whole table.
"""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_tables

#: Entries (rows, their keys, keys held at the start) of a group that one fold may walk.
FOLD = 1000


def components(touched: DataFrame) -> DataFrame:
    """(row, part) of ``touched`` (row, key): rows that share keys, directly or through others.

    ``part`` is the smallest row of the group; rows that share no key are left out. A key
    is a star around its smallest row, so the edges are as many as the entries, whatever a
    key's number of rows. Each round takes the smallest label of the neighbours, then the
    label of that label, so that a chain of n rows needs about log2(n) rounds.
    """
    hubs = touched.groupBy("key").agg(F.min("row").alias("hub"), F.max("row").alias("last"))
    spokes = touched.join(hubs.filter("hub <> last").drop("last"), "key").filter("row <> hub")
    spokes = spokes.select("row", "hub").distinct()
    turned = spokes.select(F.col("hub").alias("row"), F.col("row").alias("hub"))
    edges = cut_lineage(spokes.unionByName(turned).withColumnRenamed("hub", "other"))
    labels = edges.groupBy("row").agg(F.least(F.min("other"), F.first("row")).alias("part"))
    written = []
    while True:
        changed = Observation()
        near = edges.join(labels.withColumnRenamed("row", "other"), "other").select("row", "part", F.lit(None).cast("bigint").alias("before"))
        own = labels.select("row", "part", F.col("part").alias("before"))
        least = near.unionByName(own).groupBy("row").agg(F.min("part").alias("part"), F.max("before").alias("before"))
        least = cut_lineage(least.observe(changed, F.count_if(F.col("part") < F.col("before")).alias("rows")))
        drop_tables(*written)
        if not changed.get["rows"]:
            drop_tables(edges)
            return least.select("row", "part")
        jump = least.select(F.col("row").alias("part"), F.col("part").alias("next"))
        labels = cut_lineage(least.join(jump, "part").select("row", F.col("next").alias("part")))
        written = [least, labels]


def numbered(keys: DataFrame) -> DataFrame:
    """``keys`` (key) with a number of their own, written so that it stays the same."""
    return cut_lineage(keys.select("key", F.monotonically_increasing_id().alias("number")))


def small_parts(sizes: DataFrame) -> DataFrame:
    """(part, small) from (part, entries), which may have several rows for a part."""
    total = sizes.groupBy("part").agg(F.sum("entries").alias("entries"))
    return total.select("part", (F.col("entries") <= FOLD).alias("small"))


def fold_entries(rows: DataFrame) -> DataFrame:
    """(id, refused) of ``rows`` (part, id, keys), entered in id order in each part.

    A row is refused if an accepted earlier one has one of its keys.
    """
    walk = F.expr("""
        aggregate(rows,
            named_struct('taken', cast(array() as array<bigint>), 'refused', cast(array() as array<bigint>)),
            (done, row) -> if(arrays_overlap(done.taken, row.keys),
                named_struct('taken', done.taken, 'refused', concat(done.refused, array(row.id))),
                named_struct('taken', concat(done.taken, row.keys), 'refused', done.refused)))""")
    ordered = F.sort_array(F.collect_list(F.struct("id", "keys"))).alias("rows")
    done = rows.groupBy("part").agg(ordered).withColumn("done", walk)
    every = done.select(F.explode("rows").alias("row"), F.col("done.refused").alias("refused"))
    return every.select("row.id", F.array_contains("refused", F.col("row.id")).alias("refused"))


def fold_updates(updates: DataFrame, held: DataFrame) -> DataFrame:
    """Ids refused of ``updates`` (part, id, target, keys), which take effect in id order.

    ``held`` has (part, row, key) of the keys held at the start. An update is refused if
    another row holds one of its keys; an accepted one gives its target its keys in place
    of those the target had.
    """
    walk = F.expr("""
        aggregate(updates,
            named_struct('held', coalesce(held, cast(array() as array<struct<key: bigint, row: bigint>>)),
                'refused', cast(array() as array<bigint>)),
            (done, u) -> if(exists(done.held, h -> h.row <> u.target and array_contains(u.keys, h.key)),
                named_struct('held', done.held, 'refused', concat(done.refused, array(u.id))),
                named_struct('held', concat(filter(done.held, h -> h.row <> u.target),
                    transform(u.keys, k -> named_struct('key', k, 'row', u.target))), 'refused', done.refused))
        ).refused""")
    ordered = F.sort_array(F.collect_list(F.struct("id", "target", "keys"))).alias("updates")
    start = held.groupBy("part").agg(F.collect_list(F.struct("key", "row")).alias("held"))
    return updates.groupBy("part").agg(ordered).join(start, "part", "left").select(F.explode(walk).alias("id"))

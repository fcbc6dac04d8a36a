"""Content identity: duplicate detection over three link keys, and uniqueness audits."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_tables, scratch_path
from .conflicts import components, fold_entries, fold_updates, numbered, small_parts
from .keyfilter import sieve

#: Rounds over all open rows before what is left is looked at group by group.
ROUNDS_FIRST = 2


def identity_keys(contents: DataFrame, id_col="id", carry=()) -> DataFrame:
    """(id, key, hash): one row per link key a content holds, at most three.

    A key is a struct of kind, scope and text, ``hash`` a 64-bit hash of it for cheap
    pre-selection; decisions are always made on the key. An empty ``canonical_url`` or
    ``platform_content_id`` is no key.
    """

    def key(kind, text, scope=F.lit("")):
        return F.when(
            text.isNotNull(), F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), text.alias("text"))
        )

    keys = F.array(
        key("url", F.col("content_url")),
        key("canonical", F.nullif(F.col("canonical_url"), F.lit(""))),
        key(
            "content",
            F.nullif(F.col("platform_content_id"), F.lit("")),
            F.coalesce(F.col("platform"), F.lit("")),
        ),
    )
    return (
        contents.select(F.col(id_col).alias("id"), *carry, F.explode(keys).alias("key"))
        .filter("key is not null")
        .withColumn("hash", F.xxhash64("key"))
    )


def stored_identity_conflicts(incoming, stored, id_col="seq", target=None) -> DataFrame:
    """``id_col`` of the incoming rows that share a link key with a stored content.

    An update names the stored row it replaces in the column ``target``; that row does
    not count. The stored table is first cut down to the key hashes of the batch. Those
    are written out, so Spark knows their size: it broadcasts a small batch and leaves
    the stored table unshuffled; for a big one a Bloom filter cuts it down before that.
    """
    carry = [F.col(target).alias("target")] if target else []
    held = identity_keys(incoming, id_col, carry)
    wanted = cut_lineage(held.select("hash").distinct())
    seen = sieve(identity_keys(stored), F.col("hash"), wanted, "hash").join(wanted, "hash", "left_semi")
    if not target:
        found = held.join(seen.select("key").distinct(), "key", "left_semi")
    else:
        seen = seen.groupBy("key").agg(
            F.min("id").alias("first_stored"), F.max("id").alias("last_stored")
        )
        found = held.join(seen, "key").filter("first_stored <> target or last_stored <> target")
    return found.select(F.col("id").alias(id_col)).distinct()


def rejected_ids(contents: DataFrame, id_col="id") -> DataFrame:
    """Ids refused when contents are entered one by one in id order.

    A content is refused when an earlier *accepted* content holds one of its keys; a
    refused content blocks nobody. With A-B sharing one key and B-C another, B is refused
    and C accepted, so this is neither "first per key" nor one winner per connected
    component but the greedy independent set in id order (Blelloch, Fineman, Shun,
    "Greedy sequential maximal independent set and matching are parallel on average",
    SPAA 2012).

    Each round settles, for all open rows at once, every content that is the smallest id
    on all of its keys (accepted) and everything sharing a key with those (refused). A
    round is three aggregations and one join in which each key has one row on one side: a
    key held by a third of all rows costs that many look-ups and no pairs. The smallest
    open id is settled in every round, so the loop ends; the number of rounds is the
    depth of the longest chain of refusals, not the size of the table.

    Keys nobody else holds (by far the most) are left out before the first round, by an
    aggregation over hashes. A hash shared by two keys only lets a few of them through.
    After ``ROUNDS_FIRST`` rounds, which settle all but chains, what is open is cut into
    groups, and all small ones are walked at once; rounds go on for large groups only.
    """
    held = identity_keys(contents, id_col)
    contested = held.groupBy("hash").agg(F.count("*").alias("rows")).filter("rows > 1")
    spark = contents.sparkSession
    rounds = scratch_path(spark, "rounds")
    done, remaining = 0, Observation()
    contested = cut_lineage(contested.select("hash"))
    settled = cut_lineage(
        held.join(contested, "hash", "left_semi")
        .groupBy("id")
        .agg(F.collect_list("key").alias("keys"))
        .withColumn("verdict", F.lit(None).cast("string"))
        .observe(remaining, F.count("*").alias("rows")),
        f"{rounds}/round={done}",
    )
    drop_tables(contested)
    while remaining.get["rows"]:
        opened = settled.filter("verdict is null")
        walk = _walk_groups if done == ROUNDS_FIRST else _settle_first
        done, remaining = done + 1, Observation()
        settled = cut_lineage(
            walk(opened).observe(remaining, F.count_if(F.col("verdict").isNull()).alias("rows")),
            f"{rounds}/round={done}",
        )
    return spark.read.schema(settled.schema).parquet(rounds).filter("verdict = 'refused'").select("id")


def _settle_first(opened: DataFrame) -> DataFrame:
    """One round: accepts rows that come first on all their keys, refuses who shares one."""
    entries = opened.select("id", F.size("keys").alias("holds"), F.explode("keys").alias("key"))
    first = entries.groupBy("key").agg(F.min("id").alias("winner"), F.min_by("holds", "id").alias("holds"))
    accepted = (
        first.groupBy("winner", "holds")
        .agg(F.collect_list("key").alias("keys"))
        .filter("size(keys) = holds")
    )
    taken = accepted.select("winner", F.explode("keys").alias("key"))
    verdict = F.when(F.bool_or(F.col("winner") == F.col("id")), "accepted").when(
        F.count("winner") > 0, "refused"
    )
    return (
        entries.join(taken, "key", "left")
        .groupBy("id")
        .agg(F.collect_list("key").alias("keys"), verdict.alias("verdict"))
    )


def _walk_groups(opened: DataFrame) -> DataFrame:
    """Settles all rows but those of large groups."""
    entries = opened.select("id", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b")
    shared = cut_lineage(entries.join(numbered(shared), "key").select(F.col("id").alias("row"), F.col("number").alias("key")))
    rows = components(shared).join(shared.groupBy("row").agg(F.collect_list("key").alias("keys")), "row")
    rows = cut_lineage(rows.select("part", F.col("row").alias("id"), "keys"))
    small = small_parts(rows.select("part", (F.size("keys") + 1).alias("entries")))
    rows = rows.join(small, "part")
    folded = fold_entries(rows.filter("small").drop("small"))
    verdict = F.when(F.col("refused"), "refused").otherwise("accepted")
    decided = folded.select("id", verdict.alias("verdict")).unionByName(
        rows.filter("not small").select("id", F.lit(None).cast("string").alias("verdict"))
    )
    # A row that shares no key with an open one is first on all of them.
    alone = opened.select("id", "keys").join(decided.withColumn("met", F.lit(True)), "id", "left")
    return alone.select("id", "keys", F.when(F.col("met"), F.col("verdict")).otherwise("accepted").alias("verdict"))


def refused_updates(claims: DataFrame, stored: DataFrame) -> DataFrame:
    """``seq`` of updates that claim a key another row holds when their turn comes.

    ``claims`` has (id, target, key), one row for each key that update ``id`` wants for the
    stored row ``target``, and one with a NULL key for an update that may want none;
    ``stored`` has (id, key) of the rows as they are. Updates take
    effect in id order. An accepted one gives its target the claimed keys and sets free
    those the target had.

    Only contested keys matter: claimed for one row, and claimed for or held by another. A
    key of a row that no update changes refuses all claims at once. What is left falls
    into groups of rows that share contested keys. Small groups are walked in id order, all
    at once, so a row updated many times or a chain of renamings costs one pass; rounds
    (``_take_turns``) are for groups with more than ``conflicts.FOLD`` entries. The stored
    table is first cut down to the key hashes of the batch, and keys are numbers from then on.
    """
    spark = claims.sparkSession
    path = scratch_path(spark, "updates")
    hashed = claims.filter("key is not null").withColumn("hash", F.xxhash64("key"))
    wanted = cut_lineage(hashed.select("hash").distinct())
    held = stored.select(F.col("id").alias("row"), "key").withColumn("hash", F.xxhash64("key"))
    held = sieve(held, F.col("hash"), wanted, "hash").join(wanted, "hash", "left_semi")
    held = cut_lineage(held.select("row", "key").distinct())
    touched = hashed.select("key", F.col("target").alias("row")).unionByName(held.select("key", "row"))
    contested = touched.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a <> b")
    contested = numbered(contested)
    numbers = ["id", "target", F.col("number").alias("key")]
    claimed = cut_lineage(hashed.join(contested, "key").select(*numbers).distinct())
    holds = cut_lineage(held.join(contested, "key").select("row", F.col("number").alias("key")))
    updates = claims.select("id", F.col("target").alias("row")).distinct()
    changing = updates.select("row").distinct()
    fixed = holds.join(changing, "row", "left_anti").groupBy("key")
    fixed = fixed.agg(F.min("row").alias("a"), F.max("row").alias("b"))
    hopeless = claimed.join(fixed, "key").filter("a <> target or b <> target")
    hopeless = cut_lineage(hopeless.select("id").distinct(), f"{path}/round=0")
    wants = claimed.join(hopeless, "id", "left_anti")
    moving = holds.join(changing, "row", "left_semi")
    parts = components(wants.select(F.col("target").alias("row"), "key").unionByName(moving))
    keys = wants.groupBy("id").agg(F.collect_list("key").alias("keys"))
    turns = updates.join(parts, "row").join(hopeless, "id", "left_anti").join(keys, "id", "left")
    none = F.expr("cast(array() as array<bigint>)")
    turns = turns.select("part", "id", F.col("row").alias("target"), F.coalesce("keys", none).alias("keys"))
    start = moving.join(parts, "row").select("part", F.col("row").alias("target"), F.col("key").alias("held"))
    entries = cut_lineage(turns.unionByName(start, allowMissingColumns=True))
    small = small_parts(entries.select("part", (F.coalesce(F.size("keys"), F.lit(0)) + 1).alias("entries")))
    turns = entries.filter("held is null").drop("held")
    start = entries.filter("held is not null").select("part", F.col("target").alias("row"), F.col("held").alias("key"))
    is_small, is_large = small.filter("small").select("part"), small.filter("not small").select("part")
    folded = fold_updates(turns.join(is_small, "part"), start.join(is_small, "part"))
    cut_lineage(folded, f"{path}/round=1")
    if not is_large.isEmpty():
        opened = turns.join(is_large, "part").select("id", "target", F.explode_outer("keys").alias("key"))
        holdings = start.join(is_large, "part").select(F.col("row").alias("holder"), "key")
        _take_turns(opened, holdings, path)
    drop_tables(wanted, held, contested, claimed, holds, parts, entries)
    refused = spark.read.schema("id bigint, round int").parquet(path)
    return refused.select(F.col("id").alias("seq"))


def _take_turns(opened: DataFrame, holdings: DataFrame, path: str) -> None:
    """Writes the ids of refused updates, round by round from the second.

    An update reads and writes its target, the keys it claims and the keys its target
    holds. Each round settles every update that comes first on all of these, and refuses
    every update with a key whose holder no earlier open update can change, so that a key
    wanted by a third of all updates is settled in two rounds. A round is aggregations and
    key joins over open updates and the holdings they meet; it settles at least the first
    open update, and rounds are as many as the longest chain of updates that wait for each
    other.
    """
    opened, holdings, done = cut_lineage(opened), cut_lineage(holdings), 1
    while not opened.isEmpty():
        updates = opened.select("id", "target").distinct()
        keyed = opened.filter("key is not null")
        held_now = updates.join(holdings, F.col("target") == F.col("holder")).select("id", "key")
        touched = keyed.select("id", "key").union(held_now).distinct()
        first = touched.groupBy("key").agg(F.min("id").alias("first"))
        waits = touched.join(first, "key").filter("first < id").select("id")
        turn = updates.groupBy("target").agg(F.min("id").alias("turn"))
        waits = waits.union(updates.join(turn, "target").filter("turn < id").select("id")).distinct()
        others = keyed.join(holdings, "key").filter("holder <> target").select("id", "holder")
        next_change = turn.select(F.col("target").alias("holder"), "turn")
        fixed = others.join(next_change, "holder", "left").filter("turn is null or turn >= id").select("id").distinct()
        done += 1
        refused = cut_lineage(fixed, f"{path}/round={done}")
        ready = updates.join(waits, "id", "left_anti").join(refused, "id", "left_anti")
        accepted = cut_lineage(ready.join(others.select("id"), "id", "left_anti"))
        settled = accepted.select("id").union(refused)
        gained = keyed.join(accepted.select("id"), "id", "left_semi").select(F.col("target").alias("holder"), "key")
        changed = accepted.select(F.col("target").alias("holder"))
        before = opened, holdings, accepted
        holdings = cut_lineage(holdings.join(changed, "holder", "left_anti").unionByName(gained))
        opened = cut_lineage(opened.join(settled, "id", "left_anti"))
        drop_tables(*before)


def deduplicate(contents: DataFrame, id_col="id") -> DataFrame:
    """``contents`` with the flag ``accepted``, false for rows refused as duplicates."""
    refused = rejected_ids(contents, id_col).select(
        F.col("id").alias(id_col), F.lit(False).alias("kept")
    )
    return contents.join(refused, id_col, "left").withColumn(
        "accepted", F.coalesce("kept", F.lit(True))
    ).drop("kept")


def deduplicate_incoming(incoming: DataFrame, stored: DataFrame, id_col="seq") -> DataFrame:
    """Flag ``accepted`` for new contents entered in ``id_col`` order on top of stored ones."""
    blocked = cut_lineage(stored_identity_conflicts(incoming, stored, id_col))
    fresh = incoming.join(blocked, id_col, "left_anti")
    refused = blocked.union(rejected_ids(fresh, id_col).select(F.col("id").alias(id_col)))
    return incoming.join(
        refused.withColumn("kept", F.lit(False)), id_col, "left"
    ).withColumn("accepted", F.coalesce("kept", F.lit(True))).drop("kept")


# Uniqueness rules of each table: name, key columns, columns that exempt a row when ''.
UNIQUE = {
    "creators": [("creator_name_platform", ("name", "platform"), ())],
    "projects": [("project_code", ("project_code",), ("project_code",))],
    "contents": [
        ("content_url", ("content_url",), ()),
        ("canonical_url", ("canonical_url",), ("canonical_url",)),
        ("platform_content_id", ("platform", "platform_content_id"), ("platform_content_id",)),
    ],
    "content_metrics": [("metrics_content_id", ("content_id",), ())],
}


def uniqueness_violations(df: DataFrame, table: str, id_col="id") -> DataFrame:
    """Keys held by more than one row: (rule, key_1, key_2, row_count, first_id, last_id).

    All rules of a table share one scan and one shuffle.
    """
    blank = F.lit("").alias("key_2")
    rules = []
    for name, columns, exempt in UNIQUE[table]:
        keys = [F.col(c).cast("string").alias(f"key_{n}") for n, c in enumerate(columns, 1)]
        applies = F.lit(True)
        for column in exempt:
            applies = applies & (F.col(column) != "")
        entry = F.struct(F.lit(name).alias("rule"), *keys, *([] if len(keys) > 1 else [blank]))
        rules.append(F.when(applies, entry))
    return (
        df.select(F.col(id_col).alias("row_id"), F.explode(F.array(*rules)).alias("entry"))
        .filter("entry is not null and entry.key_1 is not null and entry.key_2 is not null")
        .groupBy("entry.rule", "entry.key_1", "entry.key_2")
        .agg(
            F.count("*").alias("row_count"),
            F.min("row_id").alias("first_id"),
            F.max("row_id").alias("last_id"),
        )
        .filter("row_count > 1")
    )

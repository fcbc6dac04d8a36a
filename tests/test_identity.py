"""Duplicate decisions against the one-by-one definition."""

import random

import pytest
from pyspark.sql import functions as F

from engagement.operators import conflicts, identity
from engagement.operators.identity import (
    deduplicate,
    deduplicate_incoming,
    refused_updates,
    stored_identity_conflicts,
    uniqueness_violations,
)
from engagement.operators.joins import resolve_creators, stored_duplicates

LAYOUT = "id bigint, platform string, content_url string, canonical_url string, platform_content_id string"


def keys_of(row):
    _, platform, url, canonical, content = row
    keys = {("u", url)}
    if canonical:
        keys.add(("c", canonical))
    if content:
        keys.add(("p", platform, content))
    return keys


def one_by_one(rows, stored=()):
    seen = set().union(*[keys_of(row) for row in stored]) if stored else set()
    accepted = {}
    for row in sorted(rows):
        accepted[row[0]] = not (keys_of(row) & seen)
        if accepted[row[0]]:
            seen |= keys_of(row)
    return accepted


def decided(df, key="id"):
    return {row[key]: row["accepted"] for row in df.select(key, "accepted").collect()}


def test_refused_row_blocks_nobody(spark):
    rows = [(1, "p", "u1", "", ""), (2, "p", "u1", "", "x"), (3, "p", "u3", "", "x")]
    assert decided(deduplicate(spark.createDataFrame(rows, LAYOUT))) == {1: True, 2: False, 3: True}


def test_long_chain(spark):
    rows = [(n, "p", f"u{n // 2}", "", f"x{(n + 1) // 2}") for n in range(9)]
    assert decided(deduplicate(spark.createDataFrame(rows, LAYOUT))) == one_by_one(rows)


def test_hot_key(spark):
    rows = [(n, "p", f"u{n}", f"c{n}", "item" if n % 3 else f"x{n}") for n in range(3000)]
    assert decided(deduplicate(spark.createDataFrame(rows, LAYOUT))) == one_by_one(rows)


def test_empty_keys_never_collide(spark):
    rows = [(n, "p", f"u{n}", "", "") for n in range(5)] + [(9, "q", "u9", None, None)]
    assert all(decided(deduplicate(spark.createDataFrame(rows, LAYOUT))).values())


@pytest.mark.parametrize("seed", range(4))
def test_random_rows(spark, seed):
    draw = random.Random(seed)
    rows = [
        (n, draw.choice("pq"), f"u{draw.randrange(40)}", draw.choice(["", f"c{draw.randrange(40)}"]),
         draw.choice(["", f"x{draw.randrange(20)}"]))
        for n in draw.sample(range(1000), 80)
    ]
    decisions = decided(deduplicate(spark.createDataFrame(rows, LAYOUT)))
    assert decisions == one_by_one(rows)
    held = [keys_of(row) for row in rows if decisions[row[0]]]
    assert sum(map(len, held)) == len(set().union(*held))


def test_on_top_of_stored_rows(spark):
    draw = random.Random(7)

    def some(n, start):
        return [
            (start + i, "p", f"u{draw.randrange(90)}", "", draw.choice(["", f"x{draw.randrange(30)}"]))
            for i in range(n)
        ]

    stored, incoming = some(30, 0), some(60, 0)
    found = deduplicate_incoming(
        spark.createDataFrame(incoming, LAYOUT).withColumnRenamed("id", "seq"),
        spark.createDataFrame(stored, LAYOUT),
    )
    assert decided(found, "seq") == one_by_one(incoming, stored)
    conflicts = stored_identity_conflicts(
        spark.createDataFrame(incoming, LAYOUT), spark.createDataFrame(stored, LAYOUT), "id", target="id"
    )
    expected = {
        row[0] for row in incoming if any(keys_of(row) & keys_of(s) for s in stored if s[0] != row[0])
    }
    assert {row["id"] for row in conflicts.collect()} == expected


def test_stored_duplicates_spare_the_row_itself_and_empty_codes(spark):
    stored = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, ""), (5, "")], "id bigint, project_code string")
    updates = stored.withColumn("id", F.col("id"))
    found = stored_duplicates(updates, stored, ["project_code"], exclude_self=True)
    assert {row["id"] for row in found.collect()} == {1, 2}
    inserts = stored_duplicates(updates, stored, ["project_code"])
    assert {row["id"] for row in inserts.collect()} == {1, 2, 3}


def test_violations_skip_exempt_rows(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "A"), (3, ""), (4, "")], "id bigint, project_code string")
    found = uniqueness_violations(rows, "projects").collect()
    assert [(r["key_1"], r["row_count"], r["first_id"], r["last_id"]) for r in found] == [("A", 2, 1, 2)]


def test_resolution_order(spark):
    creators = spark.createDataFrame(
        [(1, "A", "p", "", "d1"), (2, "A", "p", "x", "d2"), (3, "A", "q", "", "d3"), (4, "A / x", "p", "", "d4")],
        "id bigint, name string, platform string, account_id string, created_at string",
    )
    cases = [
        (1, "p", None, " A ", 1),      # label "A" before name "A"
        (2, "p", None, "A / x", 4),    # newest of two equal labels
        (3, "", None, "A", 3),         # all platforms, newest label
        (4, "q", 2, "A", None),        # id of another platform decides alone
        (5, "", 2, "zzz", 2),
        (6, "p", 0, "none", None),
    ]
    refs = spark.createDataFrame(
        [case[:4] for case in cases], "ref_id bigint, platform string, creator_id bigint, creator_text string"
    )
    found = {r["ref_id"]: r["resolved_id"] for r in resolve_creators(refs, creators).collect()}
    assert found == {case[0]: case[4] for case in cases}


def walk(updates, stored):
    """Refused ids when updates (id, target, keys) take effect one after the other."""
    held = {row: set(keys) for row, keys in stored.items()}
    refused = set()
    for number, target, keys in sorted(updates):
        if any(keys & other for row, other in held.items() if row != target):
            refused.add(number)
        else:
            held[target] = set(keys)
    return refused


def refused(spark, updates, stored):
    claims = [(n, t, k) for n, t, keys in updates for k in (*keys, None)]
    held = [(row, k) for row, keys in stored.items() for k in keys]
    found = refused_updates(
        spark.createDataFrame(claims, "id bigint, target bigint, key string"),
        spark.createDataFrame(held, "id bigint, key string"),
    )
    return {r["seq"] for r in found.collect()}


def test_updates_take_turns(spark):
    stored = {1: {"A"}, 2: {"B"}, 3: {"D"}}
    assert refused(spark, [(1, 1, {"C"}), (2, 2, {"C"}), (3, 3, {"A"})], stored) == {2}
    assert refused(spark, [(1, 3, {"A"}), (2, 1, {"C"}), (3, 3, {"A"})], stored) == {1}
    assert refused(spark, [], stored) == set()


@pytest.mark.parametrize("seed", range(2))
def test_updates_equal_one_after_the_other(spark, seed):
    r = random.Random(seed)
    keys = [f"k{i}" for i in range(14)]
    stored = {row: set(r.sample(keys, r.randint(1, 2))) for row in range(8)}
    updates = [(n, r.randrange(8), set(r.sample(keys, r.randint(0, 3)))) for n in range(24)]
    # Many want one key.
    updates += [(100 + n, r.randrange(8), {"hot"}) for n in range(10)]
    assert refused(spark, updates, stored) == walk(updates, stored)


@pytest.mark.parametrize("limit", [0, 12, 10**6])
@pytest.mark.parametrize("seed", range(2))
def test_updates_are_settled_alike_in_folds_and_rounds(spark, monkeypatch, limit, seed):
    monkeypatch.setattr(conflicts, "FOLD", limit)
    r = random.Random(seed)
    keys = [f"k{i}" for i in range(30)]
    stored = {row: set(r.sample(keys, r.randint(0, 2))) for row in range(24)}
    # Rows from 18 on are never changed.
    updates = [(n, r.randrange(18), set(r.sample(keys, r.randint(0, 2)))) for n in range(60)]
    assert refused(spark, updates, stored) == walk(updates, stored)


def no_rounds(*_):
    raise AssertionError("a round")


def test_a_row_updated_a_thousand_times_takes_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(identity, "_take_turns", no_rounds)
    monkeypatch.setattr(conflicts, "FOLD", 4000)
    stored = {1: {"a0"}, 2: {"b"}, 3: {"c"}}
    updates = [(n, 1, {f"a{n % 7}"}) for n in range(1000)] + [(2000, 2, {"a5"}), (2001, 3, {"a6"}), (2002, 1, {"b"})]
    updates += [(1000 + n, 2, {f"a{n % 9}"}) for n in range(300)]
    assert refused(spark, updates, stored) == walk(updates, stored)


def test_a_key_of_an_unchanged_row_refuses_at_once(spark, monkeypatch):
    monkeypatch.setattr(identity, "_take_turns", no_rounds)
    stored = {0: {"hot"}} | {n: {f"k{n}"} for n in range(1, 3000)}
    updates = [(n, n, {"hot" if n % 3 == 0 else f"k{n}"}) for n in range(1, 3000)]
    assert refused(spark, updates, stored) == {n for n in range(1, 3000) if n % 3 == 0}


def test_many_chains_are_walked_at_once(spark, monkeypatch):
    rounds = []
    settle = identity._settle_first
    monkeypatch.setattr(identity, "_settle_first", lambda opened: rounds.append(1) or settle(opened))
    chains = spark.range(10_000 * 50).selectExpr(
        "id", "'p' as platform", "concat('u', id div 50, '-', (id % 50) div 2) as content_url", "'' as canonical_url",
        "concat('x', id div 50, '-', (id % 50 + 1) div 2) as platform_content_id",
    )
    found = deduplicate(chains).groupBy((F.col("id") % 50).alias("place")).agg(
        F.count_if("accepted").alias("accepted"), F.count("*").alias("rows")
    )
    assert {(r["place"], r["accepted"]) for r in found.collect()} == {(n, 10_000 * (n % 2 == 0)) for n in range(50)}
    assert len(rounds) == identity.ROUNDS_FIRST


@pytest.mark.parametrize("limit", [0, 10**6])
def test_rows_are_settled_alike_in_folds_and_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(conflicts, "FOLD", limit)
    monkeypatch.setattr(identity, "ROUNDS_FIRST", 0)
    draw = random.Random(3)
    rows = [(n, "p", f"u{draw.randrange(70)}", draw.choice(["", f"c{draw.randrange(70)}"]), "") for n in draw.sample(range(1000), 120)]
    assert decided(deduplicate(spark.createDataFrame(rows, LAYOUT))) == one_by_one(rows)


def test_components(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(200), draw.randrange(150)) for _ in range(160)] + [(1000 + n, 500 + n // 2) for n in range(40)]
    rows += [(1000 + n, 700 + (n + 1) // 2) for n in range(40)]
    found = {r["row"]: r["part"] for r in conflicts.components(spark.createDataFrame(rows, "row bigint, key bigint")).collect()}
    part = {row: row for row, _ in rows}
    while True:
        least = {}
        for row, key in rows:
            least[key] = min(least.get(key, row), part[row])
        after = {row: min(least[k] for r, k in rows if r == row) for row in part}
        if after == part:
            break
        part = after
    alone = {row for row in part if sum(p == part[row] for p in part.values()) == 1}
    assert found == {row: p for row, p in part.items() if row not in alone}
    assert conflicts.components(spark.createDataFrame([], "row bigint, key bigint")).count() == 0

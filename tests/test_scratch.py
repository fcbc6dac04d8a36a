"""Tables written on the way go when nothing reads them any more."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from engagement.operators.conflicts import components
from engagement.operators.identity import refused_updates
from engagement.session import cut_lineage, drop_tables, shared_folder


def tables(spark):
    return len(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/engagement/*/*/**/_SUCCESS", recursive=True))


def test_dropped_tables_are_gone(spark):
    table = cut_lineage(spark.range(3))
    before = tables(spark)
    drop_tables(table)
    assert tables(spark) == before - 1


def test_updates_leave_only_their_result(spark):
    claims = spark.range(300).select("id", (F.col("id") % 40).alias("target"), F.concat(F.lit("k"), F.col("id") % 7).alias("key"))
    stored = spark.range(40).select("id", F.concat(F.lit("k"), F.col("id")).alias("key"))
    before = tables(spark)
    found = refused_updates(claims, stored)
    assert found.count() > 0
    # The refused ids, at once and by the walk.
    assert tables(spark) - before == 2


def test_components_leave_only_their_result(spark):
    chain = spark.range(200).selectExpr("id as row", "id div 2 as key").unionByName(spark.range(200).selectExpr("id as row", "1000 + (id + 1) div 2 as key"))
    before = tables(spark)
    assert components(chain).select("part").distinct().count() == 1
    assert tables(spark) - before == 1


@pytest.mark.parametrize("master, local", [("local", True), ("local[*]", True), ("local[4,2]", True), ("local-cluster[2,1,1024]", False), ("spark://a:1", False)])
def test_only_a_local_session_makes_a_folder_of_its_own(monkeypatch, master, local):
    from types import SimpleNamespace

    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: None))
    if local:
        assert os.path.isdir(shared_folder(session))
    else:
        with pytest.raises(RuntimeError):
            shared_folder(session)

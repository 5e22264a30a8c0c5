"""Lattice encoding and aggregates; -1 is a delay."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import lattice as L

GROUPS = {"all_done": [1, 5, 13], "one_delay": [-1, 5, 13], "with_zero": [0, 5, 13], "only_zero": [0, 0], "all_delay": [-1, -1]}
WANT = {"all_done": (1, 13, 13, 1), "one_delay": (-1, -1, 13, -1), "with_zero": (0, 13, 13, 5), "only_zero": (0, 0, 0, 0), "all_delay": (-1, -1, -1, -1)}


def rows(spark, groups):
    return spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "grp string, v int").repartition(3)


def test_constants(spark):
    got = {r["name"]: r["value"] for r in L.constants(spark).collect()}
    assert (got["level2_immutable"], got["recursively_immutable"], got["eventual_level1_immutable"], got["not_involved"], got["everecursively_immutable"]) == (13, 805, 2, 0, 802)
    v = spark.createDataFrame([(5 + 8 * 100,), (-1,), (0,)], "v int")
    assert [tuple(r) for r in v.select(L.effective(F.col("v")), L.level(F.col("v")), L.encode(L.effective(F.col("v")), L.level(F.col("v")))).collect()] == [(5, 100, 805), (0, -1, -8), (0, 0, 0)]


def test_reductions(spark):
    v = F.col("v")
    got = {r[0]: tuple(r)[1:] for r in rows(spark, GROUPS).groupBy("grp").agg(L.least(v), L.most(v), L.most_ignoring_delay(v), L.least_involved(v)).collect()}
    assert got == WANT


def test_context_reductions(spark):
    v = F.col("v")
    groups = {"tt": [1, -1], "fd": [0, -1], "ff": [0, 0]}
    got = {r[0]: tuple(r)[1:] for r in rows(spark, groups).groupBy("grp").agg(L.context_modified(v), L.all_true(v), L.group_decision(v)).collect()}
    assert got == {"tt": (1, -1, 1), "fd": (-1, 0, -1), "ff": (0, 0, 0)}
    boxes = {"c": [5, -1], "d": [1, -1], "n": [1, 1]}
    assert {r[0]: r[1] for r in rows(spark, boxes).groupBy("grp").agg(L.context_container(v)).collect()} == {"c": 5, "d": -1, "n": 1}
    assert {r[0]: r[1] for r in rows(spark, {"b": [13, -1], "x": [5, -1]}).groupBy("grp").agg(L.most_or_best(v, 13)).collect()} == {"b": 13, "x": -1}


@pytest.mark.parametrize("f", [L.least, L.most, L.most_ignoring_delay, L.least_involved, L.context_modified, L.context_container, L.all_true, L.group_decision])
def test_no_rows_give_null(spark, f):
    assert rows(spark, {}).agg(f(F.col("v"))).first()[0] is None


def test_side_by_side(spark):
    df = spark.createDataFrame([(1, 5), (-1, 5), (None, 5), (3, -1)], "a int, b int")
    assert [r[0] for r in df.select(L.most_of(F.col("a"), F.col("b"))).collect()] == [5, -1, 5, -1]
    assert [r[0] for r in df.select(L.replace_delay(F.col("a"), 9)).collect()] == [1, 9, None, 3]


def test_merge_causes_and_cap(spark):
    causes = spark.createDataFrame([("e", "a", "p", "2", True), ("e", "a", "p", "1", True), ("e", "b", "q", "0", False), ("e", "c", "r", "5", True)], "elem string, cause string, place string, stmt string, high boolean")
    assert sorted(map(tuple, L.merge_causes(causes, ["elem"]).collect())) == [("e", "a", "p", "1"), ("e", "c", "r", "5")]
    assert [tuple(r) for r in L.merge_causes(causes, ["elem"], cap=1).collect()] == [("e", "a", "p", "1")]


def test_merge_outer(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", -1)], "k string, v int"), spark.createDataFrame([("y", 5), ("z", 7)], "k string, v int")
    assert sorted(map(tuple, L.merge_outer(a, b, ["k"]).collect())) == [("x", 1), ("y", -1), ("z", 7)]

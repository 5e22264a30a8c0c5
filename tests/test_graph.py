"""Graph operators on small graphs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import links as K

GRAPHS = {
    "g1": ([("c", "a"), ("c", "b")], ["ab", "c"], {"a": "a", "b": "b", "c": "abc"}),
    "g2": ([("b", "c"), ("c", "a")], ["a", "c", "b"], {"a": "a", "b": "abc", "c": "ac"}),
    "g3": ([("a", "c"), ("b", "c")], ["c", "ab"], {"a": "ac", "b": "bc", "c": "c"}),
    "g4": ([("a", "c"), ("b", "c"), ("c", "a")], ["b", "a", "c"], None),
    "g5": ([("b", "d"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c")], None, None),
}


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


@pytest.mark.parametrize("name", ["g1", "g2", "g3", "g4"])
def test_layers_and_closures(spark, name):
    rows, order, closures = GRAPHS[name]
    by = {}
    for r in G.layers(edges(spark, rows)).collect():
        by.setdefault(r["layer"], []).append(r["node"])
    assert ["".join(sorted(by[k])) for k in sorted(by)] == order
    if closures:
        for got in (G.closure(edges(spark, rows)), G.closure(edges(spark, rows), spark.createDataFrame([("a",), ("b",), ("c",)], "n string"))):
            found = {}
            for r in got.collect():
                found.setdefault(r["start"], []).append(r["node"])
            assert {k: "".join(sorted(v)) for k, v in found.items()} == closures


def test_cycle_is_cut_once(spark):
    got = {r["node"]: (r["layer"], r["how"]) for r in G.layers(edges(spark, GRAPHS["g5"][0])).collect()}
    assert [n for n in sorted(got, key=lambda n: got[n][0])] == ["a", "b", "c", "d"] and sum(h == "cut" for _, h in got.values()) == 1


def test_cycles_and_sizes(spark):
    e = edges(spark, GRAPHS["g4"][0])
    assert {r["node"]: r["cycle"] for r in G.cycle_groups(e).collect()} == {"a": "a", "b": "b", "c": "a"}
    assert tuple(G.size_and_relations(e).first()) == (3, 3)
    assert sorted(map(tuple, G.induced(e, spark.createDataFrame([("a",), ("c",)], "n string"), reverse=True).collect())) == [("a", "c"), ("c", "a")]
    assert G.closure(e, spark.createDataFrame([("b",)], "n string"), include_start=False).count() == 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_by_labels_like_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.randint(0, 39), rng.randint(0, 39)) for _ in range((30, 55, 75)[seed - 1])}) + [(50 + k, 50 + (k + 1) % 7) for k in range(7)] + [(58, 50), (56, 59), (60, None), (61, 61)]
    out = {}
    for a, b in rows:
        if b is not None:
            out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for r in rows for x in r if x is not None}
    to = {a: reach(a) for a in nodes}
    want = {a: min([a, *(b for b in to[a] if a in to[b])]) for a in nodes}
    e = spark.createDataFrame(rows, "src long, dst long").repartition(2)
    for few in (0, 10_000):
        assert {r["node"]: r["cycle"] for r in G.cycle_groups(e, few=few).collect()} == want


def test_layers_of_random_graphs(spark):
    rng = random.Random(9)
    rows = [(a, b) for a in range(30) for b in range(a) if rng.random() < 0.08] + [(40, None)]
    got = {r["node"]: r["layer"] for r in G.layers(spark.createDataFrame(rows, "src long, dst long")).collect()}
    want = {}
    for a in sorted({x for r in rows for x in r if x is not None}):
        want[a] = max((want[b] + 1 for x, b in rows if x == a and b is not None), default=0)
    assert got == want


def test_nothing(spark):
    none = edges(spark, [])
    assert G.closure(none).count() == 0 == G.layers(none).count() == G.cycle_groups(none).count()
    w = spark.createDataFrame([], "src string, dst string, w int")
    assert G.clusters(w, 0, 2).count() == 0
    assert [tuple(r) for r in G.bottleneck_links(w, spark.createDataFrame([("a",)], "n string")).collect()] == [("a", "a", 0)]


W1 = {"thisVar": {"thisVar": 0, "removed": -1, "cycle": 3, "smallerCycle": 3}, "removed": {"removed": 0, "thisVar": -1}, "smallerCycle": {"thisVar": 3}, "cycle": {"cycle": 0, "nodeMap": 3, "toDo": 3, "thisVar": 3}, "nodeMap": {"nodeMap": 0, "toDo": 3, "cycle": 3}, "toDo": {"toDo": 0, "nodeMap": 3, "cycle": 3}}
W2 = {"first": {"sa": 0, "next": -1}, "next": {"sa": 3, "first": -1, "rv": 3}, "sa": {"next": 3, "first": 0, "rv": 0}, "rv": {"sa": 0, "next": 3}}


@pytest.mark.parametrize(
    "graph, start, most, follow, want",
    [
        (W1, "toDo", 0, False, {"toDo": 0}),
        (W1, "toDo", 2, True, {"toDo": 0}),
        (W1, "toDo", 3, True, {"toDo": 0, "cycle": -1, "nodeMap": -1, "smallerCycle": -1, "thisVar": -1, "removed": -1}),
        (W1, "removed", 3, True, {"removed": 0, "thisVar": -1, "cycle": -1, "smallerCycle": -1, "nodeMap": -1, "toDo": -1}),
        (W1, "removed", 2, True, {"removed": 0, "thisVar": -1}),
        (W2, "first", 2, True, {"first": 0, "sa": 0, "next": -1, "rv": 0}),
    ],
)
def test_bottleneck_links(spark, graph, start, most, follow, want):
    e = spark.createDataFrame([(a, b, w) for a, to in graph.items() for b, w in to.items()], "src string, dst string, w int")
    got = G.bottleneck_links(e, spark.createDataFrame([(start,)], "n string"), most, follow)
    assert {r["node"]: r["w"] for r in got.collect()} == want


def test_clusters_and_spread(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "c", 2), ("c", "d", 3), ("d", "ret", 0), ("e", "ret", 0)], "src string, dst string, w int")
    c = G.clusters(e, 0, 2, one_way="ret")
    assert {r["node"]: r["cluster"] for r in c.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "ret": "ret"}
    v = spark.createDataFrame([("a", 1), ("b", -1), ("d", 0)], "node string, v int")
    assert {r["node"]: r["v"] for r in G.spread_over_clusters(v, c).where("v is not null").collect()} == {"a": -1, "b": -1, "c": -1, "d": 0}
    assert {r["node"]: r["v"] for r in G.spread_over_clusters(v, c, break_delay=True).where("v is not null").collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}


def test_call_facts(spark):
    calls = edges(spark, [("m", "p"), ("ctor", "q"), ("p", "r"), ("r", "p")])
    methods = spark.createDataFrame([("m", "T", False, False, False, False), ("ctor", "T", False, True, False, False), ("p", "T", True, False, True, False), ("q", "T", True, False, False, False), ("r", "T", True, False, True, False), ("z", "T", True, False, False, False)], "method string, type string, is_private boolean, is_ctor boolean, is_static boolean, is_abstract boolean")
    got = {r["method"]: r for r in G.call_facts(calls, methods).collect()}
    assert {m: r["status"] for m, r in got.items()} == {"m": "non_private", "ctor": "non_private", "p": "called_from_non_private", "q": "part_of_construction", "r": "called_from_non_private", "z": "not_called"}
    assert got["p"]["on_call_cycle"] and got["m"]["static_calls_only"] and not got["ctor"]["static_calls_only"]


def test_link_tables(spark):
    a = spark.createDataFrame([("x", 0), ("y", 3)], "k string, w int")
    b = spark.createDataFrame([("x", -1), ("y", 1), ("z", 1)], "k string, w int")
    assert sorted(map(tuple, K.merge_links(a, b, ["k"], minimum=2).collect())) == [("x", 0), ("y", 2), ("z", 2)]
    assert sorted(map(tuple, K.merge_delay(a, b, ["k"]).collect())) == [("x", 0), ("y", -1), ("z", -1)]
    v = spark.createDataFrame([(-1,), (805,), (1,), (5,), (13,)], "v int")
    assert [r[0] for r in v.select(K.link_of_independence(F.col("v"))).collect()] == [-1, 100, 2, 3, 4]
    w = spark.createDataFrame([(-1,), (100,), (0,), (3,), (4,)], "v int")
    assert [r[0] for r in w.select(K.independence_of_link(F.col("v"))).collect()] == [-1, 805, 1, 5, 13]


def test_mirrored_bottleneck_by_levels(spark, monkeypatch):
    rng = random.Random(28)
    pairs = {tuple(sorted(rng.sample(range(60), 2))): rng.choice([0, 1, 2, 3, 4, -1]) for _ in range(50)}
    edges = G.add_weighted(spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, w int"), mirror=True)
    starts = spark.createDataFrame([(n,) for n in (*range(9), 99, 3)], "src long")
    want = sorted(map(tuple, G.bottleneck_links(edges, starts, max_weight=3).collect()))
    # no rounds of rows per start and node are written
    names, write = [], G.written_with
    monkeypatch.setattr(G, "written_with", lambda df, name, *m: names.append(name) or write(df, name, *m))
    for limit in (G.STARTS, 0):
        monkeypatch.setattr(G, "STARTS", limit)
        assert sorted(map(tuple, G.bottleneck_links(edges, starts, max_weight=3, mirrored=True).collect())) == want
    assert "links" not in names

"""Entities, rules, flow and diagnostics on a small program."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import entities as E
from graphloom.plans import diagnostics as D
from graphloom.plans import flow as W
from graphloom.plans import rules as R
from graphloom.plans.fixpoint import NoProgress, run_rules


@pytest.fixture(scope="module")
def program(spark):
    types = spark.createDataFrame([("A", "p", None, [], None, "A", "CLASS"), ("A.In", "p", None, [], "A", "A", "CLASS"), ("B", "p", "A", ["I"], None, "B", "CLASS"), ("C", "q", "B", [], None, "C", "CLASS"), ("I", "p", None, [], None, "I", "INTERFACE")], "type_fqn string, package string, parent string, interfaces array<string>, enclosing string, primary_type string, nature string")
    methods = spark.createDataFrame([("A.f(int)", "A", "f", False, False, "PUBLIC", False, False, 1), ("B.f(int)", "B", "f", False, False, "PUBLIC", False, False, 1), ("B.f()", "B", "f", False, False, "PUBLIC", False, False, 0), ("I.g()", "I", "g", False, False, "PUBLIC", True, False, 0), ("C.size$Aspect$Size()", "C", "size$Aspect$Size", False, True, "PUBLIC", False, False, 0)], "method_fqn string, type_fqn string, name string, is_ctor boolean, is_static boolean, access string, is_abstract boolean, is_default boolean, n_params int")
    parameters = spark.createDataFrame([("A.f(int)", 0, "x", "int"), ("B.f(int)", 0, "y", "int")], "method_fqn string, index int, name string, ptype string")
    fields = spark.createDataFrame([("A:pub", "A", "PUBLIC"), ("A:prot", "A", "PROTECTED"), ("A:pack", "A", "PACKAGE"), ("A:priv", "A", "PRIVATE")], "field_fqn string, type_fqn string, access string")
    return types, methods, parameters, fields


def test_hierarchy(spark, program):
    types, methods, parameters, fields = program
    assert sorted(map(tuple, E.supers(types).collect())) == [("B", "A", 1), ("B", "I", 1), ("C", "A", 2), ("C", "B", 1), ("C", "I", 2)]
    assert sorted(map(tuple, E.overrides(types, methods, parameters).collect())) == [("B.f(int)", "A.f(int)", 1)]
    assert [r[0] for r in E.functional_interfaces(types, methods).collect()] == ["I"]
    assert E.methods_of(types, methods, "INCLUDE_SUPERTYPES").where("type = 'C'").count() == 5
    seen = {}
    for r in E.accessible_fields(types, fields).collect():
        seen.setdefault(r["type"], set()).add(r["field_fqn"][2:])
    assert seen == {"A": {"pub", "prot", "pack", "priv"}, "A.In": {"pub", "prot", "pack", "priv"}, "B": {"pub", "prot", "pack"}, "C": {"pub", "prot"}}
    assert [tuple(r)[2:] for r in E.companions(methods).collect()] == [("size", "Aspect", "Size")]
    with pytest.raises(ValueError):
        E.methods_of(types, methods, "NONE")


def test_visible_pairs_are_made_once(spark, program):
    types, _, _, fields = program
    more = fields.union(spark.createDataFrame([("A:pub", "A", "PUBLIC"), ("A:pub", "B", "PRIVATE"), ("A:none", "B", None)], fields.schema))
    out = E.accessible_fields(types.union(types.limit(2)), more)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted({*got}) and {x for x in got if x[0] == "C"} == {("C", "A:pub"), ("C", "A:prot")} and {f for x, f in got if x == "B"} == {"A:pub", "A:prot", "A:pack", "A:none"}
    # rows are made distinct before members are met, but for members in several places
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_meet_deals_frequent_keys(spark):
    many, few = spark.range(100).selectExpr("id % 3 AS k", "id AS a"), spark.range(6).selectExpr("id % 3 AS k", "id AS b")
    want = sorted((x % 3, x, y) for x in range(100) for y in range(6) if x % 3 == y % 3)
    assert sorted(map(tuple, E.meet(many, few, ["k"], slice_=5).select("k", "a", "b").collect())) == want


def test_assignable(spark, program):
    up = E.supers(program[0])
    pairs = spark.createDataFrame([("A", "C"), ("C", "A"), ("long", "int"), ("int", "long"), ("int", "java.lang.Integer"), ("A", "A"), ("java.lang.Object", "C")], "target string, source string")
    got = {(r[0], r[1]): r[2] for r in E.assignable(pairs, up).collect()}
    assert got == {("A", "C"): 2, ("C", "A"): None, ("long", "int"): 1, ("int", "long"): None, ("int", "java.lang.Integer"): 1, ("A", "A"): 0, ("java.lang.Object", "C"): 100}
    calls = spark.createDataFrame([(1, "f(A)", 0, "A", "C"), (1, "f(B)", 0, "B", "C"), (1, "f(int)", 0, "int", "C")], "call_id int, method_fqn string, index int, formal string, actual string")
    assert [tuple(r) for r in E.best_overload(calls, up).collect()] == [(1, "f(B)")]


def test_usage_golden(spark):
    refs = spark.createDataFrame(
        [("X", "field", "java.lang.System.out", "java.lang.System", "java.lang"), ("X", "method", "java.util.Random.nextInt()", "java.util.Random", "java.util"), ("X", "method", "java.util.Random.Random(long)", "java.util.Random", "java.util"), ("X", "method", "java.util.regex.Pattern.compile()", "java.util.regex.Pattern", "java.util.regex")],
        "src_type string, kind string, target_fqn string, target_type string, target_package string",
    )
    assert sorted(r["target_fqn"] for r in E.usage(refs, ["java.lang.", "java.util"]).collect()) == ["java.lang.System", "java.lang.System.out", "java.util.Random", "java.util.Random.Random(long)", "java.util.Random.nextInt()"]


def test_last_read(spark):
    df = spark.createDataFrame([("1-E", ["0-E", "2-E"], "3"), ("2:M", ["0-E", "2-E"], "3"), (None, [], "3"), (None, ["0-E"], "0")], "r string, a array<string>, i string")
    assert [r[0] for r in df.select(E.not_read_after_assignment(F.col("r"), F.col("a"), F.col("i"))).collect()] == [True, False, False, False]


def test_clauses_and_trees(spark):
    c = spark.createDataFrame([(1, "a>0", ["a"]), (1, "a>b", ["a", "b"]), (1, "c", ["c"])], "expr_id int, clause string, vars array<string>")
    v = spark.createDataFrame([(1, "a")], "expr_id int, var string")
    assert E.own_clauses(c, v).first()["clauses"] == ["a>0"] and E.own_clauses(c, v, accept=False).first()["clauses"] == ["a>b", "c"]
    x = spark.createDataFrame([("1", None, "call"), ("2", "1", "lambda"), ("3", "2", "var"), ("4", "1", "var")], "expr_id string, parent_id string, kind string")
    roots = x.where("parent_id is null").select("expr_id")
    assert E.subtree(x, roots).count() == 4 and E.subtree(x, roots, F.col("kind") == "lambda").count() == 3


def test_loops(spark):
    df = spark.createDataFrame([(0, 10, 1), (0, 10, 3), (0, 1, 1), (5, 5, 1), (0, 1, 0), (10, 0, -3)], "s int, e int, i int")
    got = [tuple(r) for r in df.select(W.loop_count(F.col("s"), F.col("e"), F.nullif(F.col("i"), F.lit(0))), W.loop_message(F.col("s"), F.col("e"), F.col("i"))).collect()]
    assert got == [(10, None), (4, None), (1, "LOOP_ONCE"), (0, "EMPTY_LOOP"), (0, "INFINITE_LOOP_CONDITION"), (4, None)]


def test_flow(spark):
    s = spark.createDataFrame([("b", 0, 2), ("b", 1, 0), ("b", 2, 2)], "block string, pos int, after int")
    assert [r["reached"] for r in W.reachability(s, ["block"], "pos").orderBy("pos").collect()] == [2, 2, 0]
    nested = spark.createDataFrame([("0", None, 2), ("0.0", "0", 1), ("0.0.0", "0.0", 2)], "block string, parent string, execution int")
    assert {r[0]: r[1] for r in W.execution_down(nested).collect()} == {"0": 2, "0.0": 1, "0.0.0": 1}
    b = spark.createDataFrame([("x", 0, "c", "1", "0", False), ("y", 0, "c", "1", "0", False), ("y", 1, "!c", "2", "0", False), ("z", 0, "c", "1", "0", False), ("z", 1, "d", "3", "0", True), ("w", 0, "c", "1", "0", False), ("w", 1, "d", "2", "0", False)], "var string, pos int, cond string, value string, old string, unconditional boolean")
    assert {r["var"]: (r["value"], r["exact"]) for r in W.merge_values(b, ["var"]).collect()} == {"x": ("c?1:0", True), "y": ("c?1:2", True), "z": ("3", True), "w": ("<unknown>", False)}
    k = spark.createDataFrame([("RETURN",), ("IF_ELSE",), ("BREAK",), ("THROW",)], "kind string")
    assert [r[0] for r in k.select(W.interrupt_of(F.col("kind"))).collect()] == [3, 0, 1, 4]


def test_diagnostics(spark):
    facts = {
        "locals": spark.createDataFrame([("m", "a", False), ("m", "b", False), ("m", "i", True)], "method_fqn string, var_id string, is_loop boolean"),
        "reads": spark.createDataFrame([("b",)], "var_id string"),
        "acts": spark.createDataFrame([("m", "b", "0", True), ("m", "b", "1", True), ("m", "b", "2", False), ("m", "b", "3", True), ("m", "a", "4", True)], "method_fqn string, var_id string, idx string, assigns boolean"),
        "conditions": spark.createDataFrame([("m", "5", "if", "x>=3", "x<=2"), ("m", "6", "assert", "a", "a"), ("m", "7", "if", "a", "b")], "method_fqn string, idx string, role string, state string, condition string"),
    }
    got = [(r["label"], r["severity"], r["stmt_idx"], r["extra"]) for r in D.diagnose(facts).collect()]
    assert sorted(got, key=str) == sorted([
        ("UNUSED_LOCAL_VARIABLE", "ERROR", None, "a"), ("UNUSED_LOOP_VARIABLE", "WARN", None, "i"), ("OVERWRITING_PREVIOUS_ASSIGNMENT", "ERROR", "0", "b"),
        ("USELESS_ASSIGNMENT", "ERROR", "3", "b"), ("CONDITION_EVALUATES_TO_CONSTANT", "ERROR", "5", "x<=2"), ("ASSERT_EVALUATES_TO_CONSTANT_TRUE", "WARN", "6", "a"),
    ], key=str)


def test_fixpoint_breaks_delays(spark):
    seed = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "elem string, needs string")

    def rule(facts, state, breaking):
        known = state.select(F.col("elem").alias("needs"), F.col("v").alias("w"))
        v = F.when(F.col("needs").isNull(), F.lit(1)).otherwise(F.coalesce("w", F.lit(-1)))
        out = facts["seed"].join(known, "needs", "left").select("elem", F.lit("P").alias("property"), v.alias("v"))
        return out.withColumn("v", F.when(F.col("v") == -1, F.lit(0)).otherwise(F.col("v"))) if breaking else out

    rounds = []
    got = {r["elem"]: (r["v"], r["inconclusive"]) for r in run_rules({"seed": seed}, [rule], spark, on_round=lambda n, s: rounds.append(n)).collect()}
    assert got == {"a": (0, True), "b": (0, True), "c": (1, False)} and rounds == list(range(len(rounds)))
    with pytest.raises(NoProgress):
        run_rules({"seed": seed}, [rule], spark, max_rounds=1)


def test_annotations_and_consistency(spark):
    df = spark.createDataFrame([("IMMUTABLE", 13), ("IMMUTABLE", 805), ("IMMUTABLE", 1), ("CONTAINER", 5), ("NOT_NULL", 5), ("INDEPENDENT", 805), ("MODIFIED", 0), ("FINAL", 0), ("FLUENT", 0)], "p string, v int")
    assert [r[0] for r in df.select(R.annotation_of(F.col("p"), F.col("v"))).collect()] == ["E2Immutable", "ERContainer", None, "Container", "NotNull", "Independent", "NotModified", "Variable", None]
    agg = R.aggregated_types(spark.createDataFrame([("x", "P", 5, ["a"], ["t", "u"]), ("y", "P", -1, ["b"], ["u"])], "impl string, property string, v int, explicit_types array<string>, transparent_types array<string>"), spark.createDataFrame([("I", "x"), ("I", "y")], "type string, impl string")).first()
    assert tuple(agg) == ("I", "P", -1, ["a", "b"], ["u"])

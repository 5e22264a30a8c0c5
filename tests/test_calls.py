"""Calls, inlining and descriptors."""

from graphloom.plans import calls as C
from graphloom.plans import diagnostics as D


def test_inlined(spark):
    df = spark.createDataFrame([("x+y", ["x", "y"], ["1", "a+2"]), ("x>0&&b", ["x"], ["5"]), ("((", [], []), (None, [], [])], "body string, names array<string>, arguments array<string>")
    assert [r["inlined"] for r in C.inlined(df).collect()] == ["3+a", "b", None, None]


def test_descriptors(spark):
    df = spark.createDataFrame([("(I[Ljava/lang/String;[[J)V",), ("()Ljava/util/Map$Entry;",)], "descriptor string")
    assert [(r["arguments"], r["returns"]) for r in C.descriptor_types(df).collect()] == [(["int", "java.lang.String[]", "long[][]"], "void"), ([], "java.util.Map$Entry")]


def test_call_diagnostics(spark):
    calls = spark.createDataFrame([("m", "0", "f", "o", True, False), ("f", "1", "m", "n", False, False), ("m", "2", "unknown", None, True, False)], "caller string, stmt_idx string, callee string, scope string, result_ignored boolean, caller_finalizer boolean")
    methods = spark.createDataFrame([("f", "f", 1, 0, 0, False, None, False, True), ("m", "m", 0, 0, 0, False, None, True, True)], "callee string, callee_name string, modifying int, fluent int, identity int, returns_void boolean, callee_only string, callee_finalizer boolean, requires_not_null boolean")
    scopes = spark.createDataFrame([("o", "field", 13, 1, False, False, False), ("n", "parameter", 1, 5, False, True, False)], "scope string, scope_kind string, scope_immutable int, scope_not_null int, scope_not_modified boolean, scope_is_null boolean, scope_is_string boolean")
    cycles = spark.createDataFrame([("m", "f"), ("f", "f")], "node string, cycle string")
    got = {(r["label"], r["stmt_idx"]) for r in D.diagnose({"call_props": C.call_properties(calls, methods, scopes, cycles)}).collect()}
    assert got == {("CALL_CYCLE_NOT_NULL", "0"), ("CALL_CYCLE_NOT_NULL", "1"), ("CALLING_MODIFYING_METHOD_ON_IMMUTABLE", "0"), ("POTENTIAL_NULL_POINTER_EXCEPTION", "0"), ("NULL_POINTER_EXCEPTION", "1"), ("FINALIZER_METHOD_CALLED_ON_PARAMETER", "1")}


def test_preconditions_in_the_callers_terms(spark):
    names = spark.createDataFrame([("a", "b", "x", "this.f"), ("a", "b", "y", "z")], "caller string, callee string, old string, new string")
    own = spark.createDataFrame([("b", "x>0||y==xx")], "callee string, clause string")
    assert [tuple(r) for r in C.sufficient(names, own).collect()] == [("a", "this.f>0||z==xx")]

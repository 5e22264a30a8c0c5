"""A query for each diagnostic label, over fact tables made from the driver's tables.

A fact table is a table and an expression for each column that Spark and DuckDB read alike, so both sides start
from the same facts; what makes a row offending is said in SQL once more, by itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans import diagnostics as D
from graphloom.plans import flow as W
from graphloom.plans.catalogue import query, t


def _case(on: str, *values: int | str) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {k} THEN {text(v)}" for k, v in enumerate(values[:-1]))
    return f"CASE {on} % {len(values)} {whens} ELSE {text(values[-1])} END"


_ORDER, _LINE, _PART, _SUPP = (f"CAST({c} AS STRING)" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
_ANNOTATIONS = ("Modified", "NotModified", "Dependent", "Independent", "Nullable", "NotNull", "Precondition")
_HALF = "CAST(CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS STRING)"
_VAR = "CONCAT(CAST(user_id AS STRING), ':', event_type)"

#: (table, {column: expression}, filter or none) by fact table.
FACTS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "call_props": ("lineitem", {
        "caller": _ORDER, "stmt_idx": _LINE, "callee": _SUPP, "in_call_cycle": "l_orderkey % 5 = 0", "requires_not_null": "l_suppkey % 2 = 0", "modifying": "CAST(l_suppkey % 3 AS INT) - 1",
        "scope_immutable": _case("l_partkey", -1, 1, 5, 13, 11, 12, 805, 3), "scope_not_modified": "l_partkey % 7 = 0", "result_ignored": "l_linenumber % 2 = 0", "returns_void": "l_suppkey % 5 = 0",
        "fluent": "CAST(l_suppkey % 4 AS INT)", "identity": "CAST(l_suppkey % 6 AS INT)", "callee_name": _case("l_suppkey", "toString", "m", "n"), "scope_is_string": "l_partkey % 2 = 0", "scope_is_null": "l_partkey % 11 = 0",
        "scope_not_null": _case("l_partkey", -1, 1, 5, 13), "required_not_null": _case("l_suppkey", 1, 13, 21), "argument_not_null": _case("l_linenumber", -1, 5, 13), "callee_only": _case("l_suppkey", "after", "before", "none"),
        "callee_finalizer": "l_suppkey % 13 = 0", "scope_kind": _case("l_partkey", "field", "parameter", "local"), "caller_finalizer": "l_orderkey % 17 = 0",
    }, None),
    "assignments": ("lineitem", {
        "method_fqn": _ORDER, "idx": _LINE, "target": "CONCAT('v', CAST(l_suppkey % 10 AS STRING))", "value": "CONCAT('v', CAST(l_partkey % 10 AS STRING))", "current": "CONCAT('v', CAST(l_linenumber AS STRING))",
        "kind": _case("l_suppkey", "field", "parameter", "local"), "owner_primary": "l_suppkey % 4", "own_primary": "l_orderkey % 4",
    }, None),
    "expected": ("lineitem", {"elem": _ORDER, "annotation": _case("l_suppkey", *_ANNOTATIONS)}, None),
    "unexpected": ("lineitem", {"elem": _ORDER, "annotation": _case("(l_suppkey + l_linenumber)", *_ANNOTATIONS)}, None),
    "computed": ("lineitem", {"elem": _ORDER, "annotation": _case("l_partkey", *_ANNOTATIONS)}, None),
    "expected_params": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "annotation": _case("o_custkey", "Only", "Mark", "Precondition", "Container"), "params": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CONCAT('p', CAST(o_custkey % 3 AS STRING)) END"}, None),
    "computed_params": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "annotation": _case("o_custkey", "Only", "Mark", "Precondition", "Container"), "params": "CONCAT('p', CAST(o_orderkey % 3 AS STRING))"}, None),
    "acts": ("events", {"method_fqn": "CAST(user_id AS STRING)", "var_id": _VAR, "idx": "LPAD(CAST(event_id AS STRING), 12, '0')", "assigns": "event_id % 3 <> 0"}, None),
    "locals": ("events", {"method_fqn": "CAST(user_id AS STRING)", "var_id": _VAR, "is_loop": "user_id % 2 = 0"}, None),
    "reads": ("events", {"var_id": _VAR}, "event_id % 29 = 0"),
    "parameters": ("part", {"var_id": "CAST(p_partkey AS STRING)", "overrides": "p_size % 7 = 0", "companion": "p_size % 11 = 0"}, None),
    "parameter_reads": ("lineitem", {"var_id": _PART}, "l_suppkey % 9 = 0"),
    "type_cycles": ("nation", {"node": "n_name", "cycle": "CAST(n_regionkey AS STRING)"}, None),
    "binary_ops": ("lineitem", {"method_fqn": _ORDER, "idx": _LINE, "op": _case("l_suppkey", "/", "%", "+"), "rhs": "CAST(l_partkey % 10 AS STRING)"}, None),
    "duplicate_marks": ("supplier", {"type": "CAST(s_nationkey AS STRING)", "field": "CAST(s_suppkey AS STRING)"}, "s_acctbal < 0"),
    "field_not_null": ("lineitem", {"field": _ORDER, "value_v": "CASE WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN 1 ELSE 5 END", "context_v": "CASE WHEN l_suppkey % 10 = 0 THEN 5 ELSE 1 END"}, None),
    "parameter_contracts": ("part", {"parameter": "CAST(p_partkey AS STRING)", "contract": _case("p_size", "after", "before", "none"), "context": _case("p_partkey", 11, 12, 5, -1), "type_v": _case("p_partkey", 10, 11, 12, 13, 1)}, None),
    "type_values": ("customer", {"type": "CAST(c_custkey AS STRING)", "immutable": _case("c_custkey", -1, 5, 13, 21, 805), "independent": _case("c_custkey", 1, 13, 805)}, None),
    "method_independence": ("orders", {"type": "CAST(o_custkey AS STRING)", "method": "CAST(o_orderkey AS STRING)", "type_v": _case("o_custkey", 1, 5, 805), "method_v": _case("o_orderkey", -1, 1, 5, 805)}, None),
    "independence": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "property": "'INDEPENDENT'", "v": _case("o_custkey", -1, 1, 5, 13, 805)}, None),
    "method_values": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "property": _case("o_orderkey", "MODIFIED", "NOT_NULL"), "v": "CAST(o_custkey % 7 AS INT) - 1"}, None),
    "parameter_values": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "property": "'NOT_NULL'", "v": _case("o_custkey", 1, 5, 13)}, None),
    "type_property_values": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "property": "'CONTAINER'", "v": _case("o_custkey", 1, 5, -1)}, None),
    "overrides": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "other": _HALF}, None),
    "hierarchy": ("orders", {"elem": "CAST(o_orderkey AS STRING)", "other": _HALF}, None),
    "flow": ("lineitem", {"method_fqn": _ORDER, "idx": _LINE, "in_loop": "l_suppkey % 2 = 0", "interrupt": "CAST(l_partkey % 5 AS INT)", "last_of_loop": "l_linenumber > 2", "execution": "CAST(l_suppkey % 3 AS INT)", "reached": "CAST(l_partkey % 3 AS INT)"}, None),
    "could_be_static": ("orders", {"method": "CAST(o_orderkey AS STRING)"}, "o_custkey % 3 = 0"),
    "field_values": ("supplier", {"field": "CAST(s_suppkey AS STRING)", "is_private": "s_suppkey % 2 = 0", "is_static": "s_suppkey % 3 = 0", "final": _case("s_suppkey", -1, 0, 1), "type_has_finalizer": "s_suppkey % 4 = 0", "initialiser": _case("s_suppkey", "0", "1", "x", "0", "2"), "`default`": "'0'"}, None),
    "field_reads": ("lineitem", {"field": _SUPP}, "l_partkey % 50 = 0 AND l_suppkey % 4 = 0"),
    "type_uses": ("orders", {"type": "CAST(o_custkey + 100 AS STRING)"}, None),
    "conditions": ("part", {
        "method_fqn": "CAST(p_partkey AS STRING)", "idx": "CAST(p_size AS STRING)", "role": _case("p_partkey", "assert", "if", "if_enn", "inline", "inline_enn", "part", "switch", "precondition"),
        "state": "CONCAT('a>=', CAST(p_size AS STRING))", "condition": "CASE WHEN p_size % 2 = 0 THEN 'a>=10' ELSE 'a<=9' END",
    }, None),
}


def fact(spark, d, name: str):
    table, columns, where = FACTS[name]
    rows = t(spark, d, table)
    return (rows.where(where) if where else rows).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def _cte(name: str) -> str:
    table, columns, where = FACTS[name]
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items() if c[0] != "`") + f" FROM {table}" + (f" WHERE {where})" if where else ")")


def diagnostic(label: str, severity: str, kind: str, sql: str, *needs: str, renamed: dict[str, str] | None = None) -> None:
    """A query of one label's messages. ``sql`` gives loc_id, stmt_idx and extra; ``renamed``: fact tables under other names."""
    text = f"WITH {', '.join(map(_cte, needs))}, o AS ({sql}) SELECT DISTINCT '{label}' AS label, '{severity}' AS severity, '{kind}' AS loc_kind, loc_id, stmt_idx, extra FROM o"

    @query(f"d_{label.lower()}", text)
    def run(spark, d):
        return D.diagnose({(renamed or {}).get(n, n): fact(spark, d, n) for n in needs}, [label])


_ABSENT = "SELECT e.elem AS loc_id, CAST(NULL AS VARCHAR) AS stmt_idx, {extra} AS extra FROM expected e WHERE {where} NOT EXISTS (SELECT 1 FROM computed c WHERE c.elem = e.elem AND c.annotation = e.annotation)"
_NO = "CAST(NULL AS VARCHAR)"
_PARAMS = "SELECT e.elem AS loc_id, CAST(NULL AS VARCHAR) AS stmt_idx, {extra} AS extra FROM expected_params e JOIN computed_params c USING (elem, annotation) WHERE {where} e.params IS DISTINCT FROM c.params"

diagnostic("ANNOTATION_ABSENT", "ERROR", "element", _ABSENT.format(extra="e.annotation", where=""), "expected", "computed")
diagnostic("ANNOTATION_UNEXPECTEDLY_PRESENT", "ERROR", "element", f"SELECT elem AS loc_id, {_NO} AS stmt_idx, annotation AS extra FROM (SELECT * FROM unexpected INTERSECT SELECT * FROM computed)", "unexpected", "computed")
diagnostic("WRONG_ANNOTATION_PARAMETER", "ERROR", "element", _PARAMS.format(extra="annotation", where=""), "expected_params", "computed_params")
diagnostic("ONLY_WRONG_MARK_LABEL", "ERROR", "method", _PARAMS.format(extra="annotation", where="annotation IN ('Only', 'Mark', 'TestMark') AND"), "expected_params", "computed_params")
diagnostic("PRECONDITION_ABSENT", "ERROR", "method", _ABSENT.format(extra=_NO, where="e.annotation = 'Precondition' AND"), "expected", "computed")
diagnostic("WRONG_PRECONDITION", "ERROR", "method", _PARAMS.format(extra=_NO, where="annotation = 'Precondition' AND"), "expected_params", "computed_params")


def _assignment(label: str, severity: str, where: str) -> None:
    diagnostic(label, severity, "method", f"SELECT method_fqn AS loc_id, idx AS stmt_idx, target AS extra FROM assignments WHERE {where}", "assignments")


_assignment("ASSIGNMENT_TO_CURRENT_VALUE", "WARN", "value = current AND target <> value")
_assignment("ASSIGNMENT_TO_SELF", "ERROR", "target = value")
_assignment("ASSIGNMENT_TO_FIELD_OUTSIDE_TYPE", "ERROR", "kind = 'field' AND owner_primary <> own_primary")
_assignment("PARAMETER_SHOULD_NOT_BE_ASSIGNED_TO", "ERROR", "kind = 'parameter'")


def _call(label: str, severity: str, where: str) -> None:
    diagnostic(label, severity, "method", f"SELECT caller AS loc_id, stmt_idx, callee AS extra FROM call_props WHERE {where}", "call_props")


_call("CALL_CYCLE_NOT_NULL", "INFO", "in_call_cycle AND requires_not_null")
_call("CALLING_MODIFYING_METHOD_ON_IMMUTABLE", "ERROR", "modifying = 1 AND scope_immutable IN (13, 805)")
_call("MODIFICATION_NOT_ALLOWED", "ERROR", "modifying = 1 AND scope_not_modified")
_call("IGNORING_RESULT_OF_METHOD_CALL", "WARN", "result_ignored AND modifying = 0 AND NOT returns_void AND fluent <> 1 AND identity <> 1")
_call("UNNECESSARY_METHOD_CALL", "WARN", "callee_name = 'toString' AND scope_is_string")
_call("NULL_POINTER_EXCEPTION", "ERROR", "scope_is_null")
_call("POTENTIAL_NULL_POINTER_EXCEPTION", "WARN", "NOT scope_is_null AND scope_not_null = 1")
_call("POTENTIAL_CONTENT_NOT_NULL", "WARN", "required_not_null >= 13 AND argument_not_null = 5")
_call("EVENTUAL_AFTER_REQUIRED", "ERROR", "callee_only = 'after' AND scope_immutable IN (3, 11)")
_call("EVENTUAL_BEFORE_REQUIRED", "ERROR", "callee_only = 'before' AND scope_immutable IN (5, 13, 12, 805)")
_call("FINALIZER_METHOD_CALLED_ON_FIELD_NOT_IN_FINALIZER", "ERROR", "callee_finalizer AND scope_kind = 'field' AND NOT caller_finalizer")
_call("FINALIZER_METHOD_CALLED_ON_PARAMETER", "ERROR", "callee_finalizer AND scope_kind = 'parameter'")

diagnostic("OVERWRITING_PREVIOUS_ASSIGNMENT", "ERROR", "method", "SELECT method_fqn AS loc_id, idx AS stmt_idx, var_id AS extra FROM (SELECT *, lead(assigns) OVER (PARTITION BY method_fqn, var_id ORDER BY idx) AS after FROM acts) WHERE assigns AND after", "acts")
diagnostic("USELESS_ASSIGNMENT", "ERROR", "method", "SELECT method_fqn AS loc_id, idx AS stmt_idx, var_id AS extra FROM acts a WHERE assigns AND NOT EXISTS (SELECT 1 FROM acts b WHERE b.method_fqn = a.method_fqn AND b.var_id = a.var_id AND b.idx > a.idx AND NOT b.assigns) AND var_id IN (SELECT var_id FROM reads)", "locals", "reads", "acts")
diagnostic("UNUSED_LOCAL_VARIABLE", "ERROR", "method", f"SELECT method_fqn AS loc_id, {_NO} AS stmt_idx, var_id AS extra FROM locals WHERE NOT is_loop AND var_id NOT IN (SELECT var_id FROM reads)", "locals", "reads")
diagnostic("UNUSED_LOOP_VARIABLE", "WARN", "method", f"SELECT method_fqn AS loc_id, {_NO} AS stmt_idx, var_id AS extra FROM locals WHERE is_loop AND var_id NOT IN (SELECT var_id FROM reads)", "locals", "reads")
diagnostic("UNUSED_PARAMETER", "WARN", "parameter", f"SELECT var_id AS loc_id, {_NO} AS stmt_idx, {_NO} AS extra FROM parameters WHERE NOT overrides AND NOT companion AND var_id NOT IN (SELECT var_id FROM parameter_reads)", "parameters", "parameter_reads", renamed={"parameter_reads": "reads"})
diagnostic("CIRCULAR_TYPE_DEPENDENCY", "WARN", "type", f"SELECT cycle AS loc_id, {_NO} AS stmt_idx, string_agg(DISTINCT node, ',' ORDER BY node) AS extra FROM type_cycles GROUP BY cycle HAVING count(*) > 1", "type_cycles")
diagnostic("CONTRADICTING_ANNOTATIONS", "ERROR", "element", "SELECT elem AS loc_id, CAST(NULL AS VARCHAR) AS stmt_idx, CAST(NULL AS VARCHAR) AS extra FROM computed GROUP BY elem HAVING (bool_or(annotation = 'Modified') AND bool_or(annotation = 'NotModified')) OR (bool_or(annotation = 'Dependent') AND bool_or(annotation = 'Independent')) OR (bool_or(annotation = 'Nullable') AND bool_or(annotation = 'NotNull'))", "computed")
diagnostic("DIVISION_BY_ZERO", "ERROR", "method", f"SELECT method_fqn AS loc_id, idx AS stmt_idx, {_NO} AS extra FROM binary_ops WHERE op <> '+' AND rhs = '0'", "binary_ops")
diagnostic("DUPLICATE_MARK_CONDITION", "ERROR", "type", f"SELECT type AS loc_id, {_NO} AS stmt_idx, field AS extra FROM duplicate_marks", "duplicate_marks")
diagnostic("FIELD_INITIALIZATION_NOT_NULL_CONFLICT", "WARN", "field", f"SELECT field AS loc_id, {_NO} AS stmt_idx, {_NO} AS extra FROM field_not_null GROUP BY field HAVING min(value_v) = 1 AND max(context_v) = 5", "field_not_null")


def _contract(label: str, where: str) -> None:
    diagnostic(label, "ERROR", "parameter", f"SELECT parameter AS loc_id, {_NO} AS stmt_idx, {_NO} AS extra FROM parameter_contracts WHERE {where}", "parameter_contracts")


_contract("INCOMPATIBLE_IMMUTABILITY_CONTRACT_AFTER", "contract = 'after' AND context = 11")
_contract("INCOMPATIBLE_IMMUTABILITY_CONTRACT_BEFORE", "contract = 'before' AND context = 12")
_contract("INCOMPATIBLE_IMMUTABILITY_CONTRACT_BEFORE_NOT_EVENTUALLY_IMMUTABLE", "contract = 'before' AND type_v IN (13, 1)")
diagnostic("INCONSISTENT_INDEPENDENCE_VALUE", "INFO", "type", f"SELECT type AS loc_id, {_NO} AS stmt_idx, {_NO} AS extra FROM type_values WHERE (immutable = 805 AND independent <> 805) OR (immutable IN (13, 21) AND independent >> 3 < (immutable >> 3) - 1)", "type_values")
diagnostic("TYPE_HAS_HIGHER_VALUE_FOR_INDEPENDENT", "ERROR", "type", f"SELECT type AS loc_id, {_NO} AS stmt_idx, method AS extra FROM method_independence WHERE type_v > method_v AND method_v >= 0", "method_independence")


def _worse(label: str, kind: str, values: str, pairs: str, extra: str) -> None:
    sql = f"SELECT a.elem AS loc_id, {_NO} AS stmt_idx, {extra} AS extra FROM {values} a JOIN {pairs} p ON p.elem = a.elem JOIN {values} b ON b.elem = p.other AND b.property = a.property WHERE a.v >= 0 AND b.v >= 0 AND a.v < b.v"
    diagnostic(label, "ERROR", kind, sql, values, pairs)


_worse("METHOD_HAS_LOWER_VALUE_FOR_INDEPENDENT", "method", "independence", "overrides", "p.other")
_worse("WORSE_THAN_OVERRIDDEN_METHOD", "method", "method_values", "overrides", "a.property")
_worse("WORSE_THAN_OVERRIDDEN_METHOD_PARAMETER", "parameter", "parameter_values", "overrides", "a.property")
_worse("WORSE_THAN_IMPLEMENTED_INTERFACE", "type", "type_property_values", "hierarchy", "a.property")

diagnostic("INTERRUPT_IN_LOOP", "ERROR", "method", f"SELECT method_fqn AS loc_id, idx AS stmt_idx, {_NO} AS extra FROM flow WHERE in_loop AND interrupt IN (1, 3, 4) AND last_of_loop AND execution = 2", "flow")
diagnostic("UNREACHABLE_STATEMENT", "ERROR", "method", f"SELECT method_fqn AS loc_id, idx AS stmt_idx, {_NO} AS extra FROM flow WHERE reached = 0", "flow")
diagnostic("METHOD_SHOULD_BE_MARKED_STATIC", "ERROR", "method", f"SELECT method AS loc_id, {_NO} AS stmt_idx, {_NO} AS extra FROM could_be_static", "could_be_static")


def _field(label: str, severity: str, where: str, *more: str) -> None:
    diagnostic(label, severity, "field", f"SELECT field AS loc_id, {_NO} AS stmt_idx, {_NO} AS extra FROM field_values WHERE {where}", "field_values", *more)


_field("NON_PRIVATE_FIELD_NOT_FINAL", "ERROR", "NOT is_private AND final = 0")
_field("PRIVATE_FIELD_NOT_READ", "ERROR", "is_private AND NOT is_static AND field NOT IN (SELECT field FROM field_reads)", "field_reads")
_field("TYPES_WITH_FINALIZER_ONLY_EFFECTIVELY_FINAL", "ERROR", "type_has_finalizer AND final = 0")
_field("UNNECESSARY_FIELD_INITIALIZER", "WARN", "initialiser = '0'")
diagnostic("TYPE_ANALYSIS_NOT_AVAILABLE", "INFO", "type", f"SELECT type AS loc_id, {_NO} AS stmt_idx, {_NO} AS extra FROM type_uses WHERE type NOT IN (SELECT type FROM type_values)", "type_uses", "type_values")


def _loop(label: str, severity: str, where: str) -> None:
    @query(f"d_{label.lower()}", f"SELECT '{label}' AS label, '{severity}' AS severity, 'method' AS loc_kind, CAST(p_partkey AS VARCHAR) AS loc_id, '0' AS stmt_idx, CAST(NULL AS VARCHAR) AS extra FROM part WHERE {where}")
    def run(spark, d):
        message = W.loop_message(F.lit(10), F.col("p_size"), F.col("p_size") % 4).alias("message")
        return D.diagnose({"loops": t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("method_fqn"), F.lit("0").alias("idx"), message)}, [label])


_loop("EMPTY_LOOP", "ERROR", "p_size <= 10")
_loop("INFINITE_LOOP_CONDITION", "WARN", "p_size > 10 AND p_size % 4 = 0")
_loop("LOOP_ONCE", "WARN", "p_size > 10 AND p_size % 4 > 0 AND p_size - 10 <= p_size % 4")


def _constant(label: str, severity: str, role: str, value: str) -> None:
    known = "p_size >= 10 AND " + {"true": "p_size % 2 = 0", "false": "p_size % 2 = 1", "any": "true"}[value]
    sql = f"WITH {_cte('conditions')} SELECT '{label}' AS label, '{severity}' AS severity, 'method' AS loc_kind, method_fqn AS loc_id, idx AS stmt_idx, condition AS extra FROM conditions JOIN part ON p_partkey = CAST(method_fqn AS BIGINT) WHERE role = '{role}' AND {known}"

    @query(f"d_{label.lower()}", sql)
    def run(spark, d):
        return D.constant_conditions(fact(spark, d, "conditions")).where(F.col("label") == label)


_constant("ASSERT_EVALUATES_TO_CONSTANT_TRUE", "WARN", "assert", "true")
_constant("ASSERT_EVALUATES_TO_CONSTANT_FALSE", "ERROR", "assert", "false")
_constant("CONDITION_EVALUATES_TO_CONSTANT", "ERROR", "if", "any")
_constant("CONDITION_EVALUATES_TO_CONSTANT_ENN", "WARN", "if_enn", "any")
_constant("INLINE_CONDITION_EVALUATES_TO_CONSTANT", "ERROR", "inline", "any")
_constant("INLINE_CONDITION_EVALUATES_TO_CONSTANT_ENN", "WARN", "inline_enn", "any")
_constant("PART_OF_EXPRESSION_EVALUATES_TO_CONSTANT", "ERROR", "part", "any")
_constant("TRIVIAL_CASES_IN_SWITCH", "ERROR", "switch", "any")
_constant("INCOMPATIBLE_PRECONDITION", "ERROR", "precondition", "false")

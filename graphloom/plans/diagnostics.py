"""Diagnostics: each is a query that returns the offending rows; a registry says what each needs and how bad it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lattice import value

#: Labels whose severity isn't ERROR.
WARN = frozenset(
    "ASSERT_EVALUATES_TO_CONSTANT_TRUE ASSIGNMENT_TO_CURRENT_VALUE CIRCULAR_TYPE_DEPENDENCY CONDITION_EVALUATES_TO_CONSTANT_ENN FIELD_INITIALIZATION_NOT_NULL_CONFLICT "
    "IGNORING_RESULT_OF_METHOD_CALL INFINITE_LOOP_CONDITION INLINE_CONDITION_EVALUATES_TO_CONSTANT_ENN LOOP_ONCE POTENTIAL_CONTENT_NOT_NULL POTENTIAL_NULL_POINTER_EXCEPTION "
    "UNNECESSARY_FIELD_INITIALIZER UNNECESSARY_METHOD_CALL UNUSED_LOOP_VARIABLE UNUSED_PARAMETER".split()
)
INFO = frozenset("CALL_CYCLE_NOT_NULL INCONSISTENT_INDEPENDENCE_VALUE TYPE_ANALYSIS_NOT_AVAILABLE".split())


def severity(label: str) -> str:
    return "WARN" if label in WARN else "INFO" if label in INFO else "ERROR"


def messages(rows: DataFrame, label: str, loc_kind: str, loc_id: str, stmt_idx: str | None = None, extra: str | None = None) -> DataFrame:
    """Offending rows as messages, each once."""
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    return rows.select(F.lit(label).alias("label"), F.lit(severity(label)).alias("severity"), F.lit(loc_kind).alias("loc_kind"), text(loc_id).alias("loc_id"), text(stmt_idx).alias("stmt_idx"), text(extra).alias("extra")).distinct()


def combined(parts: list[DataFrame]) -> DataFrame:
    """All messages, each once, by location and label."""
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("loc_id", "stmt_idx", "label", "extra")


def counts(all_messages: DataFrame) -> DataFrame:
    """(severity, label, n)."""
    return all_messages.groupBy("severity", "label").agg(F.count(F.lit(1)).alias("n"))


# shapes -------------------------------------------------------------------------------------------------------

def unused(declared: DataFrame, used: DataFrame, on: str = "element") -> DataFrame:
    """Declared and never used."""
    return declared.join(used.select(on), on, "left_anti")


def expected_against_computed(expected: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations that are asked for but absent, and present but asked not to be: (keys, label)."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    c = computed.select(*keys).distinct().withColumn("_c", F.lit(True))
    joined = e.join(c, keys, "full").where("_e is null or _c is null")
    return joined.select(*keys, F.when(F.col("_c").isNull(), F.lit("ANNOTATION_ABSENT")).otherwise(F.lit("ANNOTATION_UNEXPECTEDLY_PRESENT")).alias("label"))


def wrong_parameters(expected: DataFrame, computed: DataFrame, keys: list[str], value_column: str) -> DataFrame:
    """Annotations on both sides with different parameters."""
    return expected.join(computed.withColumnRenamed(value_column, "_c"), keys).where(~F.col(value_column).eqNullSafe(F.col("_c"))).select(*keys, value_column, F.col("_c").alias("computed"))


def overwritten(acts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Assignments followed by another one before anything is read: rows of ``acts``, which says ``assigns`` for each act."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return acts.withColumn("_next", F.lead("assigns").over(w)).where("assigns and _next").drop("_next")


def never_read(acts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Assignments after which nothing is read."""
    later = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return acts.withColumn("_read", F.count_if(~F.col("assigns")).over(later)).where("assigns and _read = 0").drop("_read")


def worse_than_overridden(values: DataFrame, overrides: DataFrame) -> DataFrame:
    """Methods (or parameters) whose value is below that of what they override: (elem, other, property, v, other_v)."""
    other = values.select(F.col("elem").alias("other"), "property", F.col("v").alias("other_v"))
    return values.join(overrides, "elem").join(other, ["other", "property"]).where("v >= 0 and other_v >= 0 and v < other_v").select("elem", "other", "property", "v", "other_v")


# the catalogue: label -> (tables needed, query over them) ---------------------------------------------------------

def _calls(label: str, where: str):
    return lambda f: messages(f["call_props"].where(where), label, "method", "caller", "stmt_idx", "callee")


def _where(table: str, label: str, where: str | Column, kind: str, loc: str, stmt: str | None = None, extra: str | None = None):
    return lambda f: messages(f[table].where(where), label, kind, loc, stmt, extra)


def _useless(f):
    never = unused(f["locals"], f["reads"], "var_id").select("var_id")
    return messages(never_read(f["acts"], ["method_fqn", "var_id"], ["idx"]).join(never, "var_id", "left_anti"), "USELESS_ASSIGNMENT", "method", "method_fqn", "idx", "var_id")


DIAGNOSTICS = {
    "ANNOTATION_ABSENT": (("expected", "computed"), lambda f: messages(expected_against_computed(f["expected"], f["computed"], ["elem", "annotation"]).where("label = 'ANNOTATION_ABSENT'"), "ANNOTATION_ABSENT", "element", "elem", None, "annotation")),
    "ANNOTATION_UNEXPECTEDLY_PRESENT": (("unexpected", "computed"), lambda f: messages(f["unexpected"].join(f["computed"], ["elem", "annotation"], "left_semi"), "ANNOTATION_UNEXPECTEDLY_PRESENT", "element", "elem", None, "annotation")),
    "WRONG_ANNOTATION_PARAMETER": (("expected_params", "computed_params"), lambda f: messages(wrong_parameters(f["expected_params"], f["computed_params"], ["elem", "annotation"], "params"), "WRONG_ANNOTATION_PARAMETER", "element", "elem", None, "annotation")),
    "ONLY_WRONG_MARK_LABEL": (("expected_params", "computed_params"), lambda f: messages(wrong_parameters(f["expected_params"].where("annotation in ('Only', 'Mark', 'TestMark')"), f["computed_params"], ["elem", "annotation"], "params"), "ONLY_WRONG_MARK_LABEL", "method", "elem", None, "annotation")),
    "PRECONDITION_ABSENT": (("expected", "computed"), lambda f: messages(expected_against_computed(f["expected"].where("annotation = 'Precondition'"), f["computed"].where("annotation = 'Precondition'"), ["elem", "annotation"]).where("label = 'ANNOTATION_ABSENT'"), "PRECONDITION_ABSENT", "method", "elem")),
    "WRONG_PRECONDITION": (("expected_params", "computed_params"), lambda f: messages(wrong_parameters(f["expected_params"].where("annotation = 'Precondition'"), f["computed_params"], ["elem", "annotation"], "params"), "WRONG_PRECONDITION", "method", "elem")),
    "ASSIGNMENT_TO_CURRENT_VALUE": (("assignments",), _where("assignments", "ASSIGNMENT_TO_CURRENT_VALUE", "value = current and target <> value", "method", "method_fqn", "idx", "target")),
    "ASSIGNMENT_TO_SELF": (("assignments",), _where("assignments", "ASSIGNMENT_TO_SELF", "target = value", "method", "method_fqn", "idx", "target")),
    "ASSIGNMENT_TO_FIELD_OUTSIDE_TYPE": (("assignments",), _where("assignments", "ASSIGNMENT_TO_FIELD_OUTSIDE_TYPE", "kind = 'field' and owner_primary <> own_primary", "method", "method_fqn", "idx", "target")),
    "PARAMETER_SHOULD_NOT_BE_ASSIGNED_TO": (("assignments",), _where("assignments", "PARAMETER_SHOULD_NOT_BE_ASSIGNED_TO", "kind = 'parameter'", "method", "method_fqn", "idx", "target")),
    "OVERWRITING_PREVIOUS_ASSIGNMENT": (("acts",), lambda f: messages(overwritten(f["acts"], ["method_fqn", "var_id"], ["idx"]), "OVERWRITING_PREVIOUS_ASSIGNMENT", "method", "method_fqn", "idx", "var_id")),
    "CALL_CYCLE_NOT_NULL": (("call_props",), _calls("CALL_CYCLE_NOT_NULL", "in_call_cycle and requires_not_null")),
    "CALLING_MODIFYING_METHOD_ON_IMMUTABLE": (("call_props",), _calls("CALLING_MODIFYING_METHOD_ON_IMMUTABLE", f"modifying = 1 and scope_immutable >= {value('level2_immutable')} and scope_immutable % 8 = 5")),
    "MODIFICATION_NOT_ALLOWED": (("call_props",), _calls("MODIFICATION_NOT_ALLOWED", "modifying = 1 and scope_not_modified")),
    "IGNORING_RESULT_OF_METHOD_CALL": (("call_props",), _calls("IGNORING_RESULT_OF_METHOD_CALL", "result_ignored and modifying = 0 and not returns_void and fluent <> 1 and identity <> 1")),
    "UNNECESSARY_METHOD_CALL": (("call_props",), _calls("UNNECESSARY_METHOD_CALL", "callee_name = 'toString' and scope_is_string")),
    "NULL_POINTER_EXCEPTION": (("call_props",), _calls("NULL_POINTER_EXCEPTION", "scope_is_null")),
    "POTENTIAL_NULL_POINTER_EXCEPTION": (("call_props",), _calls("POTENTIAL_NULL_POINTER_EXCEPTION", f"not scope_is_null and scope_not_null = {value('nullable')}")),
    "POTENTIAL_CONTENT_NOT_NULL": (("call_props",), _calls("POTENTIAL_CONTENT_NOT_NULL", f"required_not_null >= {value('content_not_null')} and argument_not_null between 1 and {value('content_not_null') - 1}")),
    "EVENTUAL_AFTER_REQUIRED": (("call_props",), _calls("EVENTUAL_AFTER_REQUIRED", "callee_only = 'after' and scope_immutable % 8 = 3")),
    "EVENTUAL_BEFORE_REQUIRED": (("call_props",), _calls("EVENTUAL_BEFORE_REQUIRED", "callee_only = 'before' and scope_immutable % 8 in (4, 5)")),
    "FINALIZER_METHOD_CALLED_ON_FIELD_NOT_IN_FINALIZER": (("call_props",), _calls("FINALIZER_METHOD_CALLED_ON_FIELD_NOT_IN_FINALIZER", "callee_finalizer and scope_kind = 'field' and not caller_finalizer")),
    "FINALIZER_METHOD_CALLED_ON_PARAMETER": (("call_props",), _calls("FINALIZER_METHOD_CALLED_ON_PARAMETER", "callee_finalizer and scope_kind = 'parameter'")),
    "CIRCULAR_TYPE_DEPENDENCY": (("type_cycles",), lambda f: messages(f["type_cycles"].groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("node")), ",").alias("members")).where("n > 1"), "CIRCULAR_TYPE_DEPENDENCY", "type", "cycle", None, "members")),
    "CONTRADICTING_ANNOTATIONS": (("computed",), lambda f: messages(f["computed"].groupBy("elem").agg(F.collect_set("annotation").alias("a")).where("(array_contains(a, 'Modified') and array_contains(a, 'NotModified')) or (array_contains(a, 'Dependent') and array_contains(a, 'Independent')) or (array_contains(a, 'Nullable') and array_contains(a, 'NotNull'))"), "CONTRADICTING_ANNOTATIONS", "element", "elem")),
    "DIVISION_BY_ZERO": (("binary_ops",), _where("binary_ops", "DIVISION_BY_ZERO", "op in ('/', '%') and rhs = '0'", "method", "method_fqn", "idx")),
    "DUPLICATE_MARK_CONDITION": (("duplicate_marks",), _where("duplicate_marks", "DUPLICATE_MARK_CONDITION", "true", "type", "type", None, "field")),
    "EMPTY_LOOP": (("loops",), _where("loops", "EMPTY_LOOP", "message = 'EMPTY_LOOP'", "method", "method_fqn", "idx")),
    "INFINITE_LOOP_CONDITION": (("loops",), _where("loops", "INFINITE_LOOP_CONDITION", "message = 'INFINITE_LOOP_CONDITION'", "method", "method_fqn", "idx")),
    "LOOP_ONCE": (("loops",), _where("loops", "LOOP_ONCE", "message = 'LOOP_ONCE'", "method", "method_fqn", "idx")),
    "FIELD_INITIALIZATION_NOT_NULL_CONFLICT": (("field_not_null",), lambda f: messages(f["field_not_null"].groupBy("field").agg(F.min("value_v").alias("a"), F.max("context_v").alias("b")).where(f"a = {value('nullable')} and b >= {value('not_null')}"), "FIELD_INITIALIZATION_NOT_NULL_CONFLICT", "field", "field")),
    "INCOMPATIBLE_IMMUTABILITY_CONTRACT_AFTER": (("parameter_contracts",), _where("parameter_contracts", "INCOMPATIBLE_IMMUTABILITY_CONTRACT_AFTER", "contract = 'after' and context % 8 = 3", "parameter", "parameter")),
    "INCOMPATIBLE_IMMUTABILITY_CONTRACT_BEFORE": (("parameter_contracts",), _where("parameter_contracts", "INCOMPATIBLE_IMMUTABILITY_CONTRACT_BEFORE", "contract = 'before' and context % 8 = 4", "parameter", "parameter")),
    "INCOMPATIBLE_IMMUTABILITY_CONTRACT_BEFORE_NOT_EVENTUALLY_IMMUTABLE": (("parameter_contracts",), _where("parameter_contracts", "INCOMPATIBLE_IMMUTABILITY_CONTRACT_BEFORE_NOT_EVENTUALLY_IMMUTABLE", "contract = 'before' and type_v % 8 not in (2, 3, 4)", "parameter", "parameter")),
    "INCONSISTENT_INDEPENDENCE_VALUE": (("type_values",), lambda f: messages(f["type_values"].where(~_consistent()), "INCONSISTENT_INDEPENDENCE_VALUE", "type", "type")),
    "TYPE_HAS_HIGHER_VALUE_FOR_INDEPENDENT": (("method_independence",), _where("method_independence", "TYPE_HAS_HIGHER_VALUE_FOR_INDEPENDENT", "type_v > method_v and method_v >= 0", "type", "type", None, "method")),
    "METHOD_HAS_LOWER_VALUE_FOR_INDEPENDENT": (("independence", "overrides"), lambda f: messages(worse_than_overridden(f["independence"], f["overrides"]), "METHOD_HAS_LOWER_VALUE_FOR_INDEPENDENT", "method", "elem", None, "other")),
    "WORSE_THAN_OVERRIDDEN_METHOD": (("method_values", "overrides"), lambda f: messages(worse_than_overridden(f["method_values"], f["overrides"]), "WORSE_THAN_OVERRIDDEN_METHOD", "method", "elem", None, "property")),
    "WORSE_THAN_OVERRIDDEN_METHOD_PARAMETER": (("parameter_values", "overrides"), lambda f: messages(worse_than_overridden(f["parameter_values"], f["overrides"]), "WORSE_THAN_OVERRIDDEN_METHOD_PARAMETER", "parameter", "elem", None, "property")),
    "WORSE_THAN_IMPLEMENTED_INTERFACE": (("type_property_values", "hierarchy"), lambda f: messages(worse_than_overridden(f["type_property_values"], f["hierarchy"]), "WORSE_THAN_IMPLEMENTED_INTERFACE", "type", "elem", None, "property")),
    "INTERRUPT_IN_LOOP": (("flow",), _where("flow", "INTERRUPT_IN_LOOP", "in_loop and interrupt in (1, 3, 4) and last_of_loop and execution = 2", "method", "method_fqn", "idx")),
    "UNREACHABLE_STATEMENT": (("flow",), _where("flow", "UNREACHABLE_STATEMENT", "reached = 0", "method", "method_fqn", "idx")),
    "METHOD_SHOULD_BE_MARKED_STATIC": (("could_be_static",), _where("could_be_static", "METHOD_SHOULD_BE_MARKED_STATIC", "true", "method", "method")),
    "NON_PRIVATE_FIELD_NOT_FINAL": (("field_values",), _where("field_values", "NON_PRIVATE_FIELD_NOT_FINAL", "not is_private and final = 0", "field", "field")),
    "PRIVATE_FIELD_NOT_READ": (("field_values", "field_reads"), lambda f: messages(unused(f["field_values"].where("is_private and not is_static"), f["field_reads"], "field"), "PRIVATE_FIELD_NOT_READ", "field", "field")),
    "TYPES_WITH_FINALIZER_ONLY_EFFECTIVELY_FINAL": (("field_values",), _where("field_values", "TYPES_WITH_FINALIZER_ONLY_EFFECTIVELY_FINAL", "type_has_finalizer and final = 0", "field", "field")),
    "UNNECESSARY_FIELD_INITIALIZER": (("field_values",), _where("field_values", "UNNECESSARY_FIELD_INITIALIZER", "initialiser = default", "field", "field")),
    "TYPE_ANALYSIS_NOT_AVAILABLE": (("type_uses", "type_values"), lambda f: messages(unused(f["type_uses"], f["type_values"], "type"), "TYPE_ANALYSIS_NOT_AVAILABLE", "type", "type")),
    "UNUSED_LOCAL_VARIABLE": (("locals", "reads"), lambda f: messages(unused(f["locals"].where("not is_loop"), f["reads"], "var_id"), "UNUSED_LOCAL_VARIABLE", "method", "method_fqn", None, "var_id")),
    "UNUSED_LOOP_VARIABLE": (("locals", "reads"), lambda f: messages(unused(f["locals"].where("is_loop"), f["reads"], "var_id"), "UNUSED_LOOP_VARIABLE", "method", "method_fqn", None, "var_id")),
    "USELESS_ASSIGNMENT": (("locals", "reads", "acts"), _useless),
    "UNUSED_PARAMETER": (("parameters", "reads"), lambda f: messages(unused(f["parameters"].where("not overrides and not companion"), f["reads"], "var_id"), "UNUSED_PARAMETER", "parameter", "var_id")),
}
#: Conditions that the symbolic module decides; see :func:`constant_conditions`.
SYMBOLIC = {
    "assert_true": "ASSERT_EVALUATES_TO_CONSTANT_TRUE", "assert_false": "ASSERT_EVALUATES_TO_CONSTANT_FALSE", "if": "CONDITION_EVALUATES_TO_CONSTANT", "if_enn": "CONDITION_EVALUATES_TO_CONSTANT_ENN",
    "inline": "INLINE_CONDITION_EVALUATES_TO_CONSTANT", "inline_enn": "INLINE_CONDITION_EVALUATES_TO_CONSTANT_ENN", "part": "PART_OF_EXPRESSION_EVALUATES_TO_CONSTANT", "switch": "TRIVIAL_CASES_IN_SWITCH", "precondition": "INCOMPATIBLE_PRECONDITION",
}


def _consistent() -> Column:
    from graphloom.plans.rules import consistent_independence

    return consistent_independence(F.col("immutable"), F.col("independent"))


def constant_conditions(conditions: DataFrame) -> DataFrame:
    """Messages of conditions that are constant under what is known before them.

    ``conditions``: method_fqn, idx, role ('assert', 'if', 'if_enn', 'inline', 'inline_enn', 'part', 'switch' or 'precondition'),
    state, condition, as expressions of :mod:`graphloom.functions.symbolic`. A precondition is a message only if it is false.
    """
    from graphloom.functions.symbolic import decided

    found = conditions.withColumn("value", decided("state", "condition")).where("value is not null")
    role = F.when(F.col("role") == "assert", F.concat(F.lit("assert_"), F.col("value").cast("string"))).otherwise(F.col("role"))
    names = F.create_map(*(F.lit(x) for kv in SYMBOLIC.items() for x in kv))
    own = found.where("role <> 'precondition' or not value").withColumn("label", names[role])
    weight = F.create_map(*(F.lit(x) for k in SYMBOLIC.values() for x in (k, severity(k))))
    return own.select("label", weight[F.col("label")].alias("severity"), F.lit("method").alias("loc_kind"), F.col("method_fqn").alias("loc_id"), F.col("idx").alias("stmt_idx"), F.col("condition").alias("extra")).distinct()


def diagnose(facts: dict[str, DataFrame], labels: list[str] | None = None) -> DataFrame:
    """All messages of the diagnostics whose tables are there, or of ``labels``."""
    chosen = labels or [k for k, (needs, _) in DIAGNOSTICS.items() if all(n in facts for n in needs)]
    parts = [DIAGNOSTICS[k][1](facts) for k in chosen]
    if "conditions" in facts and labels is None:
        parts.append(constant_conditions(facts["conditions"]))
    return combined(parts)

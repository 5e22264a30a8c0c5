"""Property rules: facts joined, reduced over the lattice, and decided by CASE. Delays are -1 throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import lattice as L
from graphloom.functions.lattice import DELAY, LINK, value
from graphloom.operators.entities import contained_sets
from graphloom.operators.graph import cycle_groups, reaches_flag

E2, RECURSIVE = value("level2_immutable"), value("recursively_immutable")
INDEPENDENT, DEPENDENT = value("independent"), value("dependent")


def _left(elements: DataFrame, values: DataFrame, on: str | list[str], **defaults) -> DataFrame:
    out = elements.join(values, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


# fields -------------------------------------------------------------------------------------------------------

def field_final(fields: DataFrame, assigned: DataFrame) -> DataFrame:
    """RF3: (field, v): final if declared so, or if nothing can write it from outside and no method beyond construction assigns it.

    ``fields``: field, is_final, writable_outside, is_static; ``assigned``: field, method, outside_construction. A static
    field counts every method.
    """
    later = assigned.groupBy("field").agg(F.bool_or("outside_construction").alias("later"), F.lit(True).alias("any"))
    joined = _left(fields, later, "field", later=False, any=False)
    return joined.select("field", F.when(F.col("is_final"), F.lit(1)).when(F.col("writable_outside"), F.lit(0)).when(F.col("is_static") & F.col("any"), F.lit(0)).when(F.col("later"), F.lit(0)).otherwise(F.lit(1)).alias("v"))


def field_values(fields: DataFrame, initialisers: DataFrame, assignments: DataFrame, constructors: DataFrame) -> DataFrame:
    """RF4: (field, value, origin): initialiser, values from constructors and static blocks, and the default that is left otherwise.

    ``fields``: field, type, is_final, default; ``initialisers``: field, value; ``assignments``: field, method, value;
    ``constructors``: method, type. The default counts where there's no initialiser, the field isn't declared final,
    and some constructor doesn't assign it.
    """
    inside = assignments.join(constructors.select("method"), "method", "left_semi")
    n_ctors = constructors.groupBy("type").agg(F.countDistinct("method").alias("n"))
    n_assign = inside.groupBy("field").agg(F.countDistinct("method").alias("k"))
    bare = _left(_left(fields.join(initialisers.select("field"), "field", "left_anti").where("not is_final"), n_ctors, "type", n=0), n_assign, "field", k=0)
    default = bare.where("k < n or n = 0").select("field", F.col("default").alias("value"), F.lit("default").alias("origin"))
    return initialisers.select("field", "value", F.lit("initialiser").alias("origin")).union(inside.select("field", "value", F.lit("construction").alias("origin"))).union(default)


def final_value(values: DataFrame, final: DataFrame) -> DataFrame:
    """RF10: (field, value): the one value of a final field, ``<multiple>`` for several, ``<variable>`` for a field that isn't final."""
    one = values.groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = F.when(F.col("v") == DELAY, F.lit("<delayed>")).when(F.col("v") == 0, F.lit("<variable>")).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("<multiple>"))
    return final.join(one, "field", "left").select("field", v.alias("value"))


def field_constant(values: DataFrame, final: DataFrame, type_immutable: DataFrame) -> DataFrame:
    """RF11: (field, v): one constant value, of a type at least effectively of level two. ``values``: field, value, is_constant."""
    one = values.groupBy("field").agg(F.countDistinct("value").alias("n"), F.bool_and("is_constant").alias("all"))
    joined = final.withColumnRenamed("v", "final").join(one, "field", "left").join(type_immutable.withColumnRenamed("v", "imm"), "field", "left")
    return joined.select("field", F.when((F.col("final") == DELAY) | (F.col("imm") == DELAY), F.lit(DELAY)).when((F.col("final") == 1) & (F.col("n") == 1) & F.col("all") & (F.col("imm") >= E2), F.lit(1)).otherwise(F.lit(0)).alias("v"))


def external_immutable(fields: DataFrame, values: DataFrame) -> DataFrame:
    """RF5: (field, v): MUTABLE if variable and writable outside; a recursively immutable type's value; the type's own value for itself; else the least over non-null values.

    ``fields``: field, final, writable_outside, type_v, is_self; ``values``: field, v, is_null.
    """
    least = values.where("not is_null").groupBy("field").agg(F.min("v").alias("least"))
    joined = fields.join(least, "field", "left")
    found = F.coalesce("least", F.lit(value("mutable")))
    return joined.select("field", F.when(F.col("final") == DELAY, F.lit(DELAY)).when((F.col("final") == 0) & F.col("writable_outside"), F.lit(value("mutable"))).when(F.col("type_v") == RECURSIVE, F.lit(RECURSIVE)).when(F.col("is_self"), F.col("type_v")).otherwise(found).alias("v"))


def external_not_null(fields: DataFrame, values: DataFrame, contexts: DataFrame) -> DataFrame:
    """RF6: (field, v): primitive is not null; variable and writable outside nullable; a null constant nullable; else the larger of the worst value and the best context.

    ``fields``: field, final, writable_outside, is_primitive; ``values``: field, v, is_null; ``contexts``: field, v.
    """
    worst = values.groupBy("field").agg(F.min("v").alias("worst"), F.bool_or("is_null").alias("null"))
    best = contexts.groupBy("field").agg(L.most(F.col("v")).alias("best"))
    joined = _left(fields.join(best, "field", "left"), worst, "field", null=False)
    both = L.most_of(F.coalesce("worst", F.lit(value("nullable"))), F.coalesce("best", F.lit(value("nullable"))))
    return joined.select("field", F.when(F.col("is_primitive"), F.lit(value("not_null"))).when(F.col("final") == DELAY, F.lit(DELAY)).when((F.col("final") == 0) & F.col("writable_outside"), F.lit(value("nullable"))).when(F.col("null"), F.lit(value("nullable"))).otherwise(both).alias("v"))


def modified_outside(fields: DataFrame, contexts: DataFrame, break_delay: bool = False) -> DataFrame:
    """RF13: (field, v): primitives aren't modified; true if writable outside or modified in some context; false if all are known; else delayed, or false when delays are broken.

    ``fields``: field, is_primitive, writable_outside; ``contexts``: field, v (context modified where the field is read).
    """
    seen = contexts.groupBy("field").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    joined = fields.join(seen, "field", "left")
    return joined.select("field", F.when(F.col("is_primitive"), F.lit(0)).when(F.col("writable_outside") | (F.coalesce("hi", F.lit(0)) == 1), F.lit(1)).when(F.coalesce("lo", F.lit(0)) >= 0, F.lit(0)).otherwise(F.lit(0 if break_delay else DELAY)).alias("v"))


def field_independent(fields: DataFrame) -> DataFrame:
    """RF7, RT12: (field, v) from immutable values: by level from two upwards, independent1 if unbound, else dependent. ``fields``: field, immutable, unbound, static_v."""
    imm = F.col("immutable")
    by_level = F.when(imm == RECURSIVE, F.lit(INDEPENDENT)).otherwise(L.level(imm) * 8 - 3)
    return fields.select("field", F.when(F.col("static_v") == INDEPENDENT, F.lit(INDEPENDENT)).when(imm == DELAY, F.lit(DELAY)).when(imm >= E2, by_level).when(F.col("unbound"), F.lit(value("independent1"))).otherwise(F.lit(DEPENDENT)).alias("v"))


def field_container(fields: DataFrame, values: DataFrame, break_delay: bool = False) -> DataFrame:
    """RF8: (field, v): the type's value if it is CONTAINER, else the larger of it and the least over values. ``fields``: field, type_v; ``values``: field, v."""
    least = values.groupBy("field").agg(F.min("v").alias("least"))
    joined = fields.join(least, "field", "left")
    v = F.when(F.col("type_v") == value("container"), F.col("type_v")).otherwise(L.most_of(F.col("type_v"), F.coalesce("least", F.lit(value("not_container")))))
    return joined.select("field", (L.replace_delay(v, value("not_container")) if break_delay else v).alias("v"))


def ignore_modifications(fields: DataFrame, values: DataFrame, break_delay: bool = False) -> DataFrame:
    """RF9: (field, v): not ignored for types of level two; else the largest over values, and anything but IGNORE is NOT_IGNORE. ``fields``: field, immutable; ``values``: field, v."""
    most = values.groupBy("field").agg(L.most(F.col("v")).alias("most"))
    m = F.coalesce("most", F.lit(value("not_ignore_mods")))
    v = F.when(F.col("immutable") >= E2, F.lit(value("not_ignore_mods"))).when(m == DELAY, F.lit(value("not_ignore_mods") if break_delay else DELAY)).when(m == value("ignore_mods"), m).otherwise(F.lit(value("not_ignore_mods")))
    return fields.join(most, "field", "left").select("field", v.alias("v"))


def field_links(links: DataFrame) -> DataFrame:
    """RF12, L15: (field, target, w): a delay outweighs; locals, returns and the field itself left out. ``links``: field, target, w, target_kind."""
    fine = links.where("target_kind not in ('local', 'return') and target <> field")
    return fine.groupBy("field", "target").agg(L.most(F.col("w")).alias("w"))


def before_mark(fields: DataFrame, calls: DataFrame) -> DataFrame:
    """RF14: (field, v): an eventual type, not exposed, on which no mark method is called. ``fields``: field, eventual, exposed; ``calls``: field, is_mark (1, 0, -1)."""
    marks = calls.groupBy("field").agg(L.context_modified(F.col("is_mark")).alias("m"))
    return fields.join(marks, "field", "left").select("field", F.when(~F.col("eventual") | F.col("exposed"), F.lit(0)).when(F.col("m") == 1, F.lit(0)).when(F.col("m") == DELAY, F.lit(DELAY)).otherwise(F.lit(1)).alias("v"))


def initialiser_values(fields: DataFrame, constants: DataFrame) -> DataFrame:
    """RF2: (field, value): initialisers under the constants of their type, in canonical form; ``<none>`` without one.

    ``fields``: field, type, initialiser; ``constants``: type, name, value. A type's constants are bounded by its source.
    """
    from graphloom.functions.symbolic import substituted

    names = constants.groupBy("type").agg(F.array_sort(F.collect_set(F.struct(F.col("name").alias("old"), F.col("value").alias("new")))).alias("_names"))
    none = F.array().cast("array<struct<old:string,new:string>>")
    joined = fields.join(names, "type", "left").withColumn("_names", F.coalesce("_names", none))
    return joined.select("field", F.when(F.col("initialiser").isNull(), F.lit("<none>")).otherwise(F.coalesce(substituted("initialiser", "_names"), "initialiser")).alias("value"))


def anonymous_initialisers(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """RF16: (field, modified): for fields whose initialiser is an anonymous type or a lambda, what its methods do to the outside.

    ``fields``: field, initialiser_type; ``methods``: type, modified.
    """
    seen = methods.groupBy(F.col("type").alias("initialiser_type")).agg(L.context_modified(F.col("modified")).alias("modified"))
    return fields.where("initialiser_type is not null").join(seen, "initialiser_type", "left").select("field", F.coalesce("modified", F.lit(0)).alias("modified"))


# methods ------------------------------------------------------------------------------------------------------

def method_modified(methods: DataFrame, assigned: DataFrame, contexts: DataFrame, calls: DataFrame, callee: DataFrame) -> DataFrame:
    """RM2: (method, v): constructors are; a method that assigns a field of its hierarchy is; else the largest over what it reads and calls.

    ``methods``: method, is_ctor; ``assigned``: method; ``contexts``: method, v; ``calls``: src, dst on own objects;
    ``callee``: method, v so far.
    """
    does = assigned.select("method").distinct().withColumn("does", F.lit(True))
    through = calls.join(callee.select(F.col("method").alias("dst"), "v"), "dst").select(F.col("src").alias("method"), "v")
    seen = contexts.select("method", "v").union(through).groupBy("method").agg(L.context_modified(F.col("v")).alias("seen"))
    joined = methods.join(does, "method", "left").join(seen, "method", "left")
    return joined.select("method", F.when(F.col("is_ctor") | F.col("does"), F.lit(1)).otherwise(F.coalesce("seen", F.lit(0))).alias("v"))


def modified_through_calls(methods: DataFrame, calls: DataFrame, modifying: DataFrame) -> DataFrame:
    """RM2 and RM3 at their fixpoint: (method, v): 1 for methods from which calls reach a modifying one."""
    reached = reaches_flag(calls, modifying).withColumnRenamed("node", "method").withColumn("hit", F.lit(1))
    return methods.join(reached, "method", "left").select("method", F.coalesce("hit", F.lit(0)).alias("v"))


def call_cycle_decision(values: DataFrame, calls: DataFrame) -> DataFrame:
    """RM3: (method, v): methods that call one another share a decision: one true, all true; all false, all false; else they wait."""
    cycle = cycle_groups(calls)
    joined = values.join(cycle.withColumnRenamed("node", "method"), "method", "left").withColumn("cycle", F.coalesce("cycle", "method"))
    group = joined.groupBy("cycle").agg(L.group_decision(F.col("v")).alias("decision"))
    return joined.join(group, "cycle").select("method", F.col("decision").alias("v"))


def return_value(methods: DataFrame, returned: DataFrame) -> DataFrame:
    """RM5: (method, fluent, identity, constant, not_null) from the values at its return statements.

    ``methods``: method, is_static, castable, first_compatible; ``returned``: method, is_this, is_first_parameter, is_constant, v (not-null), reachable.
    """
    g = returned.where("reachable").groupBy("method").agg(F.bool_and("is_this").alias("this"), F.bool_and("is_first_parameter").alias("first"), F.bool_and("is_constant").alias("const"), F.min("v").alias("nn"))
    joined = methods.join(g, "method", "left")
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return joined.select("method", yes(F.col("this") & F.col("castable") & ~F.col("is_static")).alias("fluent"), yes(F.col("first") & F.col("first_compatible")).alias("identity"), yes(F.col("const")).alias("constant"), F.coalesce("nn", F.lit(value("not_null"))).alias("not_null"))


def return_immutable(formal: Column, dynamic: Column, external: Column, context: Column, constant: Column) -> Column:
    """RM6: the largest of four values; a constant is recursively immutable."""
    return F.when(constant, F.lit(RECURSIVE)).otherwise(L.most_of(formal, dynamic, external, context))


def return_container(methods: DataFrame, returned: DataFrame) -> DataFrame:
    """RM7: (method, v): a container by its type, or by the least over the values it returns; void methods aren't. ``methods``: method, type_v, is_void; ``returned``: method, v."""
    least = returned.groupBy("method").agg(F.min("v").alias("least"))
    no = F.lit(value("not_container"))
    v = F.when(F.col("is_void"), no).when(F.col("type_v") == value("container"), F.col("type_v")).otherwise(L.most_of(F.col("type_v"), F.coalesce("least", no)))
    return methods.join(least, "method", "left").select("method", v.alias("v"))


def return_independent(methods: DataFrame, links: DataFrame) -> DataFrame:
    """RM10: (method, v): void and recursively immutable are independent; linked to own fields up to dependent means dependent; else by the immutable level.

    ``methods``: method, is_void, immutable; ``links``: method, w, hidden.
    """
    least = links.where("not hidden").groupBy("method").agg(F.min("w").alias("w"))
    joined = methods.join(least, "method", "left")
    imm = F.col("immutable")
    return joined.select("method", F.when(F.col("is_void") | (imm == RECURSIVE), F.lit(INDEPENDENT)).when(F.col("w") == DELAY, F.lit(DELAY)).when(F.col("w") <= LINK["dependent"], F.lit(DEPENDENT)).when(F.col("w").isNull(), F.lit(INDEPENDENT)).when(imm == DELAY, F.lit(DELAY)).when(imm >= E2, L.level(imm) * 8 - 3).otherwise(F.lit(value("independent1"))).alias("v"))


def could_be_static(methods: DataFrame, touched: DataFrame, calls: DataFrame) -> DataFrame:
    """RM8: (method): no instance field or ``this`` used, nothing overridden, not a default method, static calls only. ``methods``: method, is_static, is_ctor, overrides, is_default; ``touched``: method; ``calls``: method, is_static."""
    plain = methods.where("not is_static and not is_ctor and not overrides and not is_default")
    return plain.join(touched.select("method"), "method", "left_anti").join(calls.where("not is_static").select("method"), "method", "left_anti").select("method")


def over_implementations(values: DataFrame, implementations: DataFrame) -> DataFrame:
    """L17, RM12: (method, property, v) of an interface method from its implementations. ``implementations``: method, impl; ``values``: impl, property, v."""
    greatest = F.col("property").isin("MODIFIED", "FLUENT", "IGNORE_MODS")
    joined = implementations.join(values, "impl")
    return joined.groupBy("method", "property").agg(F.when(F.first(greatest), L.most(F.col("v"))).otherwise(F.min("v")).alias("v"))


def best_of_overridden(methods: DataFrame, overridden: DataFrame, values: DataFrame, worst: int) -> DataFrame:
    """L19, RM11: (method, v): the best among the overridden, delays aside; the worst value without any. ``overridden``: method, other; ``values``: other, v."""
    best = overridden.join(values, "other").groupBy("method").agg(L.most_ignoring_delay(F.col("v")).alias("best"))
    return methods.join(best, "method", "left").select("method", F.coalesce("best", F.lit(worst)).alias("v"))


def shallow_modified(methods: DataFrame, overridden: DataFrame, values: DataFrame) -> DataFrame:
    """RM11: (method, v) without bodies: a contract, else constructors, else the overridden, else void or fluent methods of a container. ``methods``: method, contract, is_ctor, is_void, is_fluent, in_container."""
    best = overridden.join(values, "other").groupBy("method").agg(L.most_ignoring_delay(F.col("v")).alias("best"))
    guess = F.when(F.col("in_container") & (F.col("is_void") | F.col("is_fluent")), F.lit(1)).otherwise(F.lit(0))
    return methods.join(best, "method", "left").select("method", F.coalesce("contract", F.when(F.col("is_ctor"), F.lit(1)), "best", guess).alias("v"))


def eventual(methods: DataFrame, clauses: DataFrame, assignments: DataFrame) -> DataFrame:
    """RM4, RM9: (method, role, fields): a precondition on fields makes a method ``only_before`` or ``only_after``, and ``mark`` if it makes its precondition false.

    ``methods``: method, is_boolean, modifies; ``clauses``: method, field, state ('before' or 'after'); ``assignments``: method, field, contradicts.
    """
    fields = clauses.groupBy("method").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.min("state").alias("lo"), F.max("state").alias("hi"))
    marks = assignments.where("contradicts").join(clauses.select("method", "field"), ["method", "field"], "left_semi").select("method").distinct().withColumn("mark", F.lit(True))
    joined = methods.join(fields, "method").join(marks, "method", "left")
    role = F.when(F.col("mark"), F.lit("mark")).when(F.col("is_boolean") & ~F.col("modifies"), F.lit("test_mark")).when(F.col("lo") != F.col("hi"), F.lit("conflict")).otherwise(F.concat(F.lit("only_"), F.col("lo")))
    return joined.select("method", role.alias("role"), "fields")


# parameters ---------------------------------------------------------------------------------------------------

def parameter_properties(parameters: DataFrame, fields: DataFrame, assigned: DataFrame, break_delay: bool = False) -> DataFrame:
    """RP3, RP4, RP8: (parameter, modified): its context and, over the fields that it is assigned or linked to, their modification outside.

    ``parameters``: parameter, context_modified; ``fields``: field, modified_outside; ``assigned``: parameter, field, w (link level).
    """
    near = assigned.where(f"w between {DELAY} and {LINK['dependent']}").join(fields, "field")
    outside = near.groupBy("parameter").agg(L.context_modified(F.when(F.col("w") == DELAY, F.lit(DELAY)).otherwise(F.col("modified_outside"))).alias("outside"))
    joined = parameters.join(outside, "parameter", "left")
    c, o = F.col("context_modified"), F.coalesce("outside", F.lit(0))
    v = F.when((c == 1) | (o == 1), F.lit(1)).when((c == DELAY) | (o == DELAY), F.lit(0 if break_delay else DELAY)).otherwise(F.lit(0))
    return joined.select("parameter", v.alias("modified"))


def parameter_from_fields(parameters: DataFrame, fields: DataFrame, assigned: DataFrame) -> DataFrame:
    """RP3, RP7: (parameter, property, v) copied from fields that it is assigned to; the largest, delays first. ``fields``: field, property, v."""
    own = assigned.where(F.col("w").isin(LINK["statically_assigned"], LINK["assigned"])).join(fields, "field")
    return parameters.select("parameter").join(own, "parameter").groupBy("parameter", "property").agg(L.most(F.col("v")).alias("v"))


def parameter_container(parameters: DataFrame, contexts: DataFrame, assigned: DataFrame) -> DataFrame:
    """RP6: (parameter, v): a container by contract or type; else, if no field takes it, by its contexts; a field that takes it decides otherwise.

    ``parameters``: parameter, type_v; ``contexts``: parameter, v; ``assigned``: parameter, v (of the field).
    """
    seen = contexts.groupBy("parameter").agg(L.context_container(F.col("v")).alias("context"))
    taken = assigned.groupBy("parameter").agg(F.min("v").alias("field"))
    joined = parameters.join(seen, "parameter", "left").join(taken, "parameter", "left")
    yes, no = value("container"), F.lit(value("not_container"))
    return joined.select("parameter", F.when(F.col("type_v") == yes, F.lit(yes)).otherwise(L.most_of(F.coalesce("field", F.lit(-2)), F.coalesce("context", no))).alias("v"))


def parameter_external_immutable(parameters: DataFrame, fields: DataFrame, assigned: DataFrame) -> DataFrame:
    """RP7: (parameter, v): the least external immutability over the fields that a parameter is assigned to; its type's value without any; a delay while one is missing.

    ``parameters``: parameter, type_v; ``fields``: field, v; ``assigned``: parameter, field.
    """
    least = assigned.join(fields, "field", "left").groupBy("parameter").agg(F.min(F.coalesce("v", F.lit(DELAY))).alias("least"))
    return parameters.join(least, "parameter", "left").select("parameter", F.when(F.col("least").isNull(), F.col("type_v")).when(F.col("least") == DELAY, F.lit(DELAY)).otherwise(F.greatest("least", "type_v")).alias("v"))


def parameter_independent(parameters: DataFrame, links: DataFrame) -> DataFrame:
    """RP5: (parameter, v): independent of all fields, or as the closest link says. ``links``: parameter, w."""
    from graphloom.operators.links import independence_of_link

    least = links.groupBy("parameter").agg(F.min("w").alias("w"))
    return parameters.join(least, "parameter", "left").select("parameter", F.when(F.col("w").isNull(), F.lit(INDEPENDENT)).otherwise(independence_of_link(F.col("w"))).alias("v"))


def first_round_parameters(parameters: DataFrame) -> DataFrame:
    """RP1: (parameter, property, v): contracts, and modifications of functional parameters of java.util.function ignored. ``parameters``: parameter, type_package, contracts (map)."""
    contract = parameters.select("parameter", F.explode("contracts").alias("property", "v"))
    functional = parameters.where("type_package = 'java.util.function'").select("parameter", F.lit("IGNORE_MODS").alias("property"), F.lit(value("ignore_mods")).alias("v"))
    return contract.union(functional.join(contract, ["parameter", "property"], "left_anti"))


# types --------------------------------------------------------------------------------------------------------

def all_fields_final(types: DataFrame, final: DataFrame) -> DataFrame:
    """RT7: (type, v): false outweighs a delay; a type without fields is. ``final``: type, field, v."""
    found = final.groupBy("type").agg(L.all_true(F.col("v")).alias("found"))
    return types.join(found, "type", "left").select("type", F.coalesce("found", F.lit(1)).alias("v"))


def least_of_parents(types: DataFrame, parents: DataFrame, values: DataFrame, best: int) -> DataFrame:
    """RT10: (type, v): the least over parents and enclosing types. ``parents``: type, other; ``values``: other, v."""
    least = parents.join(values, "other", "left").groupBy("type").agg(F.min(F.coalesce("v", F.lit(DELAY))).alias("least"))
    return types.join(least, "type", "left").select("type", F.coalesce("least", F.lit(best)).alias("v"))


def early_negatives(fields: DataFrame, ctor_parameters: DataFrame, methods: DataFrame, eventual_types: DataFrame) -> DataFrame:
    """RT9: (type) that can't be of level two, whatever is still delayed.

    ``fields``: type, exposed, immutable; ``ctor_parameters``: type, independent; ``methods``: type, independent, modified; ``eventual_types``: type.
    """
    exposed = fields.where(f"exposed and immutable between 0 and {E2 - 1}").select("type")
    given = ctor_parameters.where(f"independent = {DEPENDENT}").select("type")
    handed = methods.where(f"independent = {DEPENDENT}").select("type")
    changing = methods.where("modified = 1").join(eventual_types, "type", "left_anti").select("type")
    return exposed.union(given).union(handed).union(changing).distinct()


def type_immutable(types: DataFrame, e1: DataFrame, fields: DataFrame, independents: DataFrame, parents: DataFrame, is_eventual: DataFrame) -> DataFrame:
    """RT8: (type, v): level one if all fields are final (or approved), level two and more by three rules, no more than parents allow.

    ``fields``: type, modified (1, 0, -1), is_private, immutable, transparent; ``independents``: type, v (of methods and
    constructors' parameters); ``parents``: type, v; ``is_eventual``: type. Rule 1: no field modified; rule 2: every field private or
    of level two or transparent; rule 3: nothing dependent handed in or out. The level is one more than the least independence.
    """
    f = fields.groupBy("type").agg(L.all_true(1 - F.when(F.col("modified") == DELAY, F.lit(2)).otherwise(F.col("modified"))).alias("rule1"), L.all_true(F.when(F.col("is_private") | F.col("transparent"), F.lit(1)).when(F.col("immutable") == DELAY, F.lit(DELAY)).otherwise((F.col("immutable") >= E2).cast("int"))).alias("rule2"))
    i = independents.groupBy("type").agg(F.min("v").alias("least"))
    p = parents.groupBy("type").agg(F.min("v").alias("parent"))
    e = is_eventual.select("type").distinct().withColumn("eventual", F.lit(True))
    j = types.join(e1.withColumnRenamed("v", "e1"), "type", "left").join(f, "type", "left").join(i, "type", "left").join(p, "type", "left").join(e, "type", "left")
    ok, bits = F.coalesce("e1", F.lit(DELAY)), F.when(F.col("eventual"), F.lit(2)).otherwise(F.lit(5))
    rule1, rule2, least = F.coalesce("rule1", F.lit(1)), F.coalesce("rule2", F.lit(1)), F.coalesce("least", F.lit(INDEPENDENT))
    higher = F.when(least == INDEPENDENT, F.lit(L.MAX_LEVEL)).otherwise(L.level(least) + 1)
    own = (
        F.when((ok == 0) & F.col("eventual").isNull(), F.lit(value("mutable")))
        .when(ok == DELAY, F.lit(DELAY))
        .when((rule1 == 0) | (rule2 == 0) | (least == DEPENDENT), bits)
        .when((rule1 == DELAY) | (rule2 == DELAY) | (least == DELAY), F.lit(DELAY))
        .otherwise(bits + higher * 8)
    )
    parent = F.coalesce("parent", F.lit(RECURSIVE))
    return j.select("type", F.when(parent == value("mutable"), parent).otherwise(F.least(own, parent)).alias("v"))


def type_independent(types: DataFrame, parts: DataFrame, immutable: DataFrame) -> DataFrame:
    """RT11: (type, v): the least over parents, non-private fields, parameters and return values; a recursively immutable type is independent. ``parts``: type, v."""
    least = parts.groupBy("type").agg(F.min("v").alias("least"))
    j = types.join(least, "type", "left").join(immutable.withColumnRenamed("v", "imm"), "type", "left")
    return j.select("type", F.when(F.col("imm") == RECURSIVE, F.lit(INDEPENDENT)).otherwise(F.coalesce("least", F.lit(INDEPENDENT))).alias("v"))


def type_container(types: DataFrame, parameters: DataFrame, parents: DataFrame) -> DataFrame:
    """RT13: (type, v): no accessible method modifies a parameter, nor does a parent's. ``parameters``: type, modified; ``parents``: type, v."""
    seen = parameters.groupBy("type").agg(L.context_modified(F.col("modified")).alias("m"))
    p = parents.groupBy("type").agg(F.min("v").alias("parent"))
    j = types.join(seen, "type", "left").join(p, "type", "left")
    return j.select("type", F.when((F.col("m") == 1) | (F.col("parent") == value("not_container")), F.lit(value("not_container"))).when((F.col("m") == DELAY) | (F.col("parent") == DELAY), F.lit(DELAY)).otherwise(F.lit(value("container"))).alias("v"))


def approved_preconditions(methods: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RT4, RT5: fields that all non-private changing methods guard, and fields with several mark conditions.

    ``methods``: type, method, changes_field, is_private; ``clauses``: method, field, condition. Gives (type, field, condition) and
    (type, field) for DUPLICATE_MARK_CONDITION.
    """
    open_ = methods.where("not is_private").select("type", "method", F.col("changes_field").alias("field")).distinct()
    held = open_.join(clauses, ["method", "field"], "left")
    g = held.groupBy("type", "field").agg(F.bool_and(F.col("condition").isNotNull()).alias("all"), F.collect_set("condition").alias("conditions"))
    good = g.where("all and size(conditions) = 1").select("type", "field", F.col("conditions")[0].alias("condition"))
    return good, g.where("size(conditions) > 1").select("type", "field")


def guarded_fields(changers: DataFrame, approved: DataFrame, private: DataFrame) -> DataFrame:
    """RT6: (field, g): private fields whose changing methods all change an approved field too. ``changers``: field, method; ``approved``, ``private``: field."""
    inside = contained_sets(changers, "field", "method")
    return inside.join(private.select("field"), "field", "left_semi").join(approved.select(F.col("field").alias("g")), "g", "left_semi").select("field", "g")


def immutable_can_be_increased(type_parameters: DataFrame) -> DataFrame:
    """RT3: (type, v): whether some type parameter is among the hidden content. ``type_parameters``: type, hidden."""
    return type_parameters.groupBy("type").agg(F.bool_or("hidden").alias("v"))


def singleton(types: DataFrame, constructors: DataFrame, creations: DataFrame, guarded: DataFrame) -> DataFrame:
    """RT14: (type): all constructors private, called in one field's initialiser and nowhere else; or its one constructor guarded by a private static flag.

    ``constructors``: type, method, is_private; ``creations``: type, place ('field' or 'method'), elem; ``guarded``: type, method.
    """
    c = constructors.groupBy("type").agg(F.bool_and("is_private").alias("private"), F.count(F.lit(1)).alias("n"))
    m = creations.groupBy("type").agg(F.count_if(F.col("place") == "field").alias("in_fields"), F.count_if(F.col("place") == "method").alias("in_methods"))
    one = c.join(m, "type").where("private and in_fields = 1 and in_methods = 0").select("type")
    two = c.where("n = 1").join(guarded.select("type"), "type", "left_semi").select("type")
    return types.select("type").join(one.union(two).distinct(), "type", "left_semi")


def extension_class(types: DataFrame, methods: DataFrame) -> DataFrame:
    """RT15: (type): of level two; its static non-private methods, some with parameters, share the first one's type. ``types``: type, immutable; ``methods``: type, is_static, is_private, first_type, return_type, n_params, first_not_null."""
    own = methods.where("is_static and not is_private").withColumn("about", F.coalesce("first_type", "return_type"))
    g = own.groupBy("type").agg(F.countDistinct("about").alias("n"), F.max("n_params").alias("most"), F.bool_and(F.coalesce("first_not_null", F.lit(True))).alias("nn"))
    return types.where(f"immutable % 8 in (2, 5) and immutable >= {value('eventual_level2_immutable')}").join(g.where("n = 1 and most > 0 and nn"), "type", "left_semi").select("type")


def utility_class(types: DataFrame, methods: DataFrame, constructors: DataFrame, creations: DataFrame) -> DataFrame:
    """RT16: (type): of level two, all methods static, constructors all private and never called from within."""
    static = methods.groupBy("type").agg(F.bool_and("is_static").alias("s")).where("not s")
    private = constructors.groupBy("type").agg(F.bool_and("is_private").alias("p")).where("p")
    fine = types.where(f"immutable % 8 in (2, 5) and immutable >= {value('eventual_level2_immutable')}")
    return fine.join(static, "type", "left_anti").join(private, "type", "left_semi").join(creations.select("type"), "type", "left_anti").select("type")


def ignore_private_constructors(constructors: DataFrame, factories: DataFrame) -> DataFrame:
    """RT17: (type): private and public constructors, and no factory method."""
    both = constructors.groupBy("type").agg(F.bool_or("is_private").alias("a"), F.bool_or(~F.col("is_private")).alias("b")).where("a and b")
    return both.join(factories.select("type"), "type", "left_anti").select("type")


def aggregated_types(values: DataFrame, implementations: DataFrame, keep_empty_transparent: bool = False) -> DataFrame:
    """L18, RT18: (type, property, v, explicit_types, transparent_types) over the implementations.

    ``values``: impl, property, v, explicit_types, transparent_types. ``keep_empty_transparent`` reproduces an intersection
    that starts from the empty set and so stays empty.
    """
    j = implementations.join(values, "impl")
    g = j.groupBy("type", "property").agg(F.min("v").alias("v"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("explicit_types")))).alias("explicit_types"), F.collect_set("transparent_types").alias("_t"))
    empty = F.array().cast("array<string>")
    shared = empty if keep_empty_transparent else F.when(F.size("_t") > 0, F.array_sort(F.aggregate("_t", F.get("_t", F.lit(0)), lambda a, x: F.array_intersect(a, x)))).otherwise(empty)
    return g.select("type", "property", "v", "explicit_types", shared.alias("transparent_types"))


def default_immutable(types: DataFrame, arguments: DataFrame) -> DataFrame:
    """(type_use, v): a generic type's value, its level added to the least over its arguments where they count. ``types``: type_use, v; ``arguments``: type_use, v."""
    least = arguments.groupBy("type_use").agg(F.min("v").alias("a"))
    j = types.join(least, "type_use", "left")
    total = F.when((F.col("v") == DELAY) | (F.col("a") == DELAY), F.lit(DELAY)).when(F.col("a").isNull() | (F.col("v") < E2), F.col("v")).when((F.col("v") == RECURSIVE) & (F.col("a") == RECURSIVE), F.lit(RECURSIVE)).otherwise(F.least(F.lit(RECURSIVE), F.col("v").bitwiseAND(F.lit(7)) + F.least(F.lit(L.MAX_LEVEL), L.level(F.col("v")) + L.level(F.col("a"))) * 8))
    return j.select("type_use", total.alias("v"))


def consistent_independence(immutable: Column, independent: Column) -> Column:
    """Whether an independence value goes with an immutable one; delays do."""
    return F.when((immutable == DELAY) | (independent == DELAY), F.lit(True)).when(immutable == RECURSIVE, independent == INDEPENDENT).when(immutable >= E2, L.level(independent) >= L.level(immutable) - 1).otherwise(F.lit(True))


def annotation_of(prop: Column, v: Column) -> Column:
    """The annotation that a value shows as, null if none: the last step before the sinks."""
    name = F.when(prop == "IMMUTABLE", F.when(v == DELAY, F.lit(None)).when(v >= 802, F.lit("ERContainer")).when(v.bitwiseAND(F.lit(7)) < 2, F.lit(None)).otherwise(F.concat(F.lit("E"), (L.level(v) + 1).cast("string"), F.lit("Immutable"))))
    flag = lambda n, good, bad=None: F.when(prop == n, F.when(v == 1, F.lit(good)).when(v == 0, F.lit(bad)))
    return F.coalesce(
        name, F.when(prop == "CONTAINER", F.when(v == value("container"), F.lit("Container"))), F.when(prop == "NOT_NULL", F.when(v >= value("not_null"), F.lit("NotNull")).when(v == value("nullable"), F.lit("Nullable"))),
        F.when(prop == "INDEPENDENT", F.when(v == INDEPENDENT, F.lit("Independent")).when(v == DEPENDENT, F.lit("Dependent")).when(v > 0, F.concat(F.lit("Independent"), (L.level(v) + 1).cast("string")))),
        flag("MODIFIED", "Modified", "NotModified"), flag("FINAL", "Final", "Variable"), flag("FLUENT", "Fluent"), flag("IDENTITY", "Identity"), flag("CONSTANT", "Constant"), flag("SINGLETON", "Singleton"), flag("UTILITY_CLASS", "UtilityClass"), flag("EXTENSION_CLASS", "ExtensionClass"),
    )

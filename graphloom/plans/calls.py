"""Calls: what a call's value is, what it asks of its arguments, what it links, and the facts that diagnostics need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import lattice as L
from graphloom.functions.lattice import DELAY, LINK

#: C5, fixed order: how a call's value is found; the first strategy that has one wins.
STRATEGIES = ("inline_lambda", "fact", "condition", "static", "constant", "equals", "companion", "state", "identity", "fluent", "enum", "inline_return", "symbolic")


def value_of_call(candidates: DataFrame) -> DataFrame:
    """(call_id, strategy, value). ``candidates``: call_id, strategy, value; unknown strategies and null values don't count."""
    order = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    known = candidates.withColumn("_n", order).where("_n > 0 and value is not null")
    return known.groupBy("call_id").agg(F.min(F.struct("_n", "strategy", "value")).alias("b")).select("call_id", "b.strategy", "b.value")


def argument_contexts(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """(caller, var, property, v): what variables in argument places must be, the most over all calls.

    ``arguments``: caller, var, method_fqn, index; ``parameters``: method_fqn, index, property, v. A parameter without a
    value yet is a delay.
    """
    joined = arguments.join(parameters, ["method_fqn", "index"], "left")
    seen = joined.select("caller", "var", F.coalesce("property", F.lit("CONTEXT_MODIFIED")).alias("property"), F.coalesce("v", F.lit(DELAY)).alias("v"))
    return seen.groupBy("caller", "var", "property").agg(L.most(F.col("v")).alias("v"))


def call_links(arguments: DataFrame, independence: DataFrame) -> DataFrame:
    """(caller, src, dst, w): links between the object and the arguments of a call or constructor call, the closest of all calls.

    ``arguments``: caller, object, var, method_fqn, index; ``independence``: method_fqn, index, v. Independent arguments link nothing.
    """
    from graphloom.operators.links import link_of_independence

    joined = arguments.join(independence, ["method_fqn", "index"], "left")
    w = link_of_independence(F.coalesce("v", F.lit(DELAY)))
    links = joined.select("caller", F.col("object").alias("src"), F.col("var").alias("dst"), w.alias("w")).where(f"w <> {LINK['no_link']} and src is not null and dst is not null")
    return links.groupBy("caller", "src", "dst").agg(F.min("w").alias("w"))


def dynamic_immutable(formal: Column, concrete: Column) -> Column:
    """A constructor call's value is at least its concrete type's."""
    return L.most_of(formal, concrete)


def call_properties(calls: DataFrame, methods: DataFrame, scopes: DataFrame, cycles: DataFrame) -> DataFrame:
    """C4: the table that call diagnostics read: one row per call with its callee's and its object's properties.

    ``calls``: caller, stmt_idx, callee, scope, result_ignored, caller_finalizer; ``methods``: callee, callee_name, modifying, fluent,
    identity, returns_void, callee_only, callee_finalizer, requires_not_null; ``scopes``: scope, scope_kind, scope_immutable,
    scope_not_null, scope_not_modified, scope_is_null, scope_is_string; ``cycles``: node, cycle (of methods). What isn't known yet is a
    delay, so no diagnostic is raised on it.
    """
    size = cycles.groupBy("cycle").agg(F.count(F.lit(1)).alias("_n"))
    ring = cycles.join(size.where("_n > 1"), "cycle")
    a, b = ring.select(F.col("node").alias("caller"), F.col("cycle").alias("_a")), ring.select(F.col("node").alias("callee"), F.col("cycle").alias("_b"))
    joined = calls.join(methods, "callee", "left").join(scopes, "scope", "left").join(a, "caller", "left").join(b, "callee", "left")
    no = F.lit(False)
    delays = {c: F.coalesce(F.col(c), F.lit(DELAY)) for c in ("modifying", "fluent", "identity", "scope_immutable", "scope_not_null")}
    flags = {c: F.coalesce(F.col(c), no) for c in ("returns_void", "callee_finalizer", "requires_not_null", "scope_not_modified", "scope_is_null", "scope_is_string", "result_ignored", "caller_finalizer")}
    none = {c: F.lit(DELAY) for c in ("required_not_null", "argument_not_null") if c not in calls.columns}
    return joined.withColumns(delays | flags | none | {"in_call_cycle": F.coalesce(F.col("_a") == F.col("_b"), no)}).drop("_a", "_b")


def inlined(calls: DataFrame) -> DataFrame:
    """With ``inlined``: the callee's body with its parameters replaced by the arguments, in canonical form.

    ``calls``: body, names (array of parameters), arguments (array of expressions). What can't be read stays null.
    """
    import pandas as pd

    from graphloom.functions.symbolic import parse, show, substitute

    def one(body, names, arguments):
        try:
            return show(substitute(parse(body), dict(zip(names, map(parse, arguments), strict=True))))
        except (ValueError, RecursionError, AttributeError, TypeError):
            return None

    def run(batches):
        for pdf in batches:
            rows = [(b, *(None if x is None else tuple(x) for x in more)) for b, *more in zip(pdf["body"], pdf["names"], pdf["arguments"], strict=True)]
            found = {r: one(*r) for r in set(rows)}  # equal calls are worked out once
            yield pdf.assign(inlined=pd.Series([found[r] for r in rows], index=pdf.index, dtype="object"))

    from pyspark.sql.types import StringType, StructField, StructType

    return calls.mapInPandas(run, StructType([*calls.schema.fields, StructField("inlined", StringType())]))


def descriptor_types(descriptors: DataFrame, column: str = "descriptor") -> DataFrame:
    """With ``arguments`` and ``returns``: the types of a byte-code descriptor such as ``(I[Ljava/lang/String;)V``, by built-in functions."""
    names = F.create_map(*(F.lit(x) for kv in {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}.items() for x in kv))

    def name(d: Column) -> Column:
        base = F.regexp_replace(d, r"^\[+", "")
        plain = F.when(F.length(base) == 1, names[base]).otherwise(F.translate(F.regexp_extract(base, "^L(.*);$", 1), "/", "."))
        return F.concat(plain, F.repeat(F.lit("[]"), F.length(d) - F.length(base)))

    one = r"\[*(?:[BCDFIJSVZ]|L[^;]+;)"
    inside, last = F.regexp_extract(column, r"^\((.*)\)", 1), F.regexp_extract(column, r"\)(.*)$", 1)
    return descriptors.withColumns({"arguments": F.transform(F.regexp_extract_all(inside, F.lit(one), F.lit(0)), name), "returns": name(last)})


def renamed(text: Column, names: Column) -> Column:
    """A text whose words, but for strings, are replaced by a map in one pass; words that it doesn't hold stay."""
    word = r"\"(?:[^\"\\]|\\.)*\"|[A-Za-z_$][\w$.]*"
    words, gaps = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word, -1)
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(F.element_at(names, F.coalesce(w, F.lit(""))), w, F.lit("")))), "")


def sufficient(conditions: DataFrame, callee_conditions: DataFrame) -> DataFrame:
    """A callee's preconditions in the caller's terms: (caller, clause). ``conditions``: caller, callee, old, new; ``callee_conditions``: callee, clause.

    Names are replaced as whole words, all at once; of several new names for one the smallest counts.
    """
    each = conditions.groupBy("caller", "callee", "old").agg(F.min("new").alias("new"))
    names = each.groupBy("caller", "callee").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"))
    return names.join(callee_conditions, "callee").select("caller", renamed(F.col("clause"), F.col("names")).alias("clause")).distinct()


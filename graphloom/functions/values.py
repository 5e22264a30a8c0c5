"""Values that aren't expressions of their own: instances, wrappers with properties, delays, lists, type names. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.lattice import DELAY


def instance(kind: Column, not_null: Column | None = None) -> Column:
    """An opaque value of a type, with the properties that are known of it: (value, props)."""
    props = F.create_map().cast("map<string,int>") if not_null is None else F.create_map(F.lit("NOT_NULL"), not_null.cast("int"))
    return F.struct(F.concat(F.lit("<instance "), kind, F.lit(">")).alias("value"), props.alias("props"))


def wrapped(value: Column, state: Column, props: Column) -> Column:
    """A value with what is known of it besides: (value, state, props)."""
    return F.struct(value.alias("value"), F.coalesce(state, F.lit("true")).alias("state"), props.alias("props"))


def rewrapped(outer: Column, inner: Column) -> Column:
    """A wrapper around a wrapper as one: both states hold, and the outer one's properties stand before the inner one's."""
    both = F.when(inner["state"] == "true", outer["state"]).when(outer["state"] == "true", inner["state"]).otherwise(F.concat(inner["state"], F.lit("&&"), outer["state"]))
    kept = F.map_filter(inner["props"], lambda k, v: ~F.array_contains(F.map_keys(outer["props"]), k))
    return F.struct(inner["value"].alias("value"), both.alias("state"), F.map_concat(kept, outer["props"]).alias("props"))


def delayed(value: Column, causes: Column) -> Column:
    """C11: a value that waits for ``causes`` (an array), each named once, in order; without causes the value itself."""
    return F.when(F.size(causes) > 0, F.concat(F.lit("<delayed:"), F.array_join(F.array_sort(F.array_distinct(causes)), ","), F.lit(">"))).otherwise(value)


def is_delayed(value: Column) -> Column:
    return value.startswith("<delayed:")


def comma(values: Column) -> Column:
    """The value of expressions one after the other is the last one's; an empty list has none."""
    return F.try_element_at(values, F.lit(-1))


def several(values: Column, not_null: Column) -> Column:
    """Several values as one, its property the least of theirs, a delay outweighing: (values, not_null)."""
    return F.struct(F.concat(F.lit("{"), F.array_join(values, ","), F.lit("}")).alias("value"), F.coalesce(F.array_min(not_null), F.lit(DELAY)).alias("not_null"))


def enclosed(text: Column) -> Column:
    """An expression without parentheses around the whole of it, one pair; ``(a)+(b)`` keeps its."""
    inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    marks = F.regexp_replace(inner, r"[^()]", "")
    # (lowest depth inside, depth at its end): the pair closes at the end if the inside never goes below its own level
    step = lambda acc, c: F.struct(F.least(acc["low"], acc["at"] + F.when(c == "(", 1).otherwise(-1)).alias("low"), (acc["at"] + F.when(c == "(", 1).otherwise(-1)).alias("at"))
    told = F.reduce(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("low"), F.lit(0).alias("at")), step)
    return F.when(text.startswith("(") & text.endswith(")") & (told["low"] == 0) & (told["at"] == 0), inner).otherwise(text)


def special(kind: Column, name: Column) -> Column:
    """The texts of values that no evaluation gives: unknown, empty, an expanded variable, a contract's mark."""
    return F.when(kind == "unknown", F.concat(F.lit("<unknown:"), name, F.lit(">"))).when(kind == "empty", F.lit("<empty>")).when(kind == "expanded", F.concat(F.lit("<expanded:"), name, F.lit(">"))).when(kind == "contract", F.concat(F.lit("@Mark("), name, F.lit(")"))).otherwise(name)


def member_values(text: Column) -> Column:
    """C14: ``a=1, b=x`` as a map; a text without names is the one of ``value``; ``X.class`` is the type X."""
    plain = F.regexp_replace(text, r"\b([\w.$]+)\.class\b", "$1")
    parts = F.filter(F.split(plain, r"\s*,\s*"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.when(p.contains("="), F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.trim(F.split_part(p, F.lit("="), F.lit(2))).alias("v"))).otherwise(F.struct(F.lit("value").alias("k"), F.trim(p).alias("v"))))
    return F.map_from_entries(named)


def erased(kind: Column) -> Column:
    """A type without its type arguments, from the innermost outwards: four levels, and what is left after a fifth ``<``."""
    for _ in range(4):
        kind = F.regexp_replace(kind, r"<[^<>]*>", "")
    return F.regexp_replace(kind, r"<.*>", "")



"""The property lattice as plain Columns: encoding, decoding, and aggregates that know delays.

A value is ``effective + 8 * level``; -1 is a delay, a value not known yet. The aggregates are SQL aggregates, so
they combine on the map side and generate code; which of them a rule needs is the rule's matter, since for some a
delay outweighs a value and for others not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = -1
#: The low three bits.
EFFECTIVE = {"DELAY": 0, "FALSE": 1, "EVENTUAL": 2, "EVENTUAL_BEFORE": 3, "EVENTUAL_AFTER": 4, "EFFECTIVE": 5}
MAX_LEVEL = 100
#: Named properties as (effective, level).
CONSTANTS = {
    "not_involved": (0, 0), "nullable": (1, 0), "not_null": (5, 0), "not_null_after": (4, 0), "content_not_null": (5, 1), "content2_not_null": (5, 2),
    "mutable": (1, 0), "level1_immutable": (5, 0), "level2_immutable": (5, 1), "level3_immutable": (5, 2), "recursively_immutable": (5, 100),
    "eventual_level1_immutable": (2, 0), "eventual_level2_immutable": (2, 1), "everecursively_immutable": (2, 100),
    "e1before": (3, 0), "e2before": (3, 1), "recursive_before": (3, 100), "e1after": (4, 0), "e2after": (4, 1), "recursive_after": (4, 100),
    "dependent": (1, 0), "independent1": (5, 0), "independent2": (5, 1), "independent": (5, 100),
    "not_container": (1, 0), "container": (5, 0), "not_ignore_mods": (1, 0), "ignore_mods": (5, 0),
}
#: Link levels and execution.
LINK = {"statically_assigned": 0, "assigned": 1, "dependent": 2, "independent1": 3, "independent2": 4, "no_link": 100}
EXECUTION = {"NEVER": 0, "CONDITIONALLY": 1, "ALWAYS": 2, "DEFAULT": 3}
INTERRUPT = {"no": 0, "break": 1, "continue": 2, "return": 3, "escape": 4}


def value(name: str) -> int:
    effective, level = CONSTANTS[name]
    return effective + 8 * level


def constants(spark) -> DataFrame:
    """(name, effective, level, value) of the named properties."""
    return spark.createDataFrame([(n, e, k, e + 8 * k) for n, (e, k) in CONSTANTS.items()], "name string, effective int, level int, value int")


def encode(effective: Column, level: Column) -> Column:
    return effective + level * 8


def effective(v: Column) -> Column:
    """The low bits; a delay's are those of DELAY."""
    return F.when(v < 0, F.lit(0)).otherwise(v.bitwiseAND(F.lit(7)))


def level(v: Column) -> Column:
    """The level; that of a delay is -1."""
    return F.when(v < 0, F.lit(-1)).otherwise(F.shiftright(v, 3))


def is_delayed(v: Column) -> Column:
    return v == DELAY


def least(v: Column) -> Column:
    """L1: the smallest; any delay wins, being smallest."""
    return F.min(v)


def most(v: Column) -> Column:
    """L2: a delay wins, else the largest."""
    return F.when(F.min(v) == DELAY, F.lit(DELAY)).otherwise(F.max(v))


def most_ignoring_delay(v: Column) -> Column:
    """L3: the largest; a delay if there is nothing else."""
    return F.max(v)


def least_involved(v: Column) -> Column:
    """L4: the smallest but 0, which anything absorbs."""
    return F.coalesce(F.min(F.nullif(v, F.lit(0))), F.when(F.count(v) > 0, F.lit(0)))


def most_or_best(v: Column, best: int) -> Column:
    """The best value outweighs delays, else L2."""
    return F.when(F.max(v) == best, F.lit(best)).otherwise(most(v))


def context_modified(v: Column) -> Column:
    """True, else a delay, else false."""
    return F.when(F.max(v) == 1, F.lit(1)).when(F.min(v) == DELAY, F.lit(DELAY)).when(F.count(v) > 0, F.lit(0))


def context_container(v: Column) -> Column:
    """Container, else a delay, else not."""
    return F.when(F.max(v) == value("container"), F.lit(value("container"))).when(F.min(v) == DELAY, F.lit(DELAY)).when(F.count(v) > 0, F.lit(value("not_container")))


def all_true(v: Column) -> Column:
    """RT7: false outweighs a delay, which outweighs true."""
    return F.when(F.min(F.when(v == 0, F.lit(0))) == 0, F.lit(0)).when(F.min(v) == DELAY, F.lit(DELAY)).when(F.count(v) > 0, F.lit(1))


def group_decision(v: Column) -> Column:
    """RM3: one true decides for all; all false decide; else the group waits."""
    return F.when(F.max(v) == 1, F.lit(1)).when(F.min(v) == 0, F.lit(0)).when(F.count(v) > 0, F.lit(DELAY))


def first_of(x: Column, order: Column) -> Column:
    """The first that isn't null, in a stated order; null without any."""
    return F.min_by(x, F.when(x.isNotNull(), order))


def any_of(x: Column) -> Column:
    """Whether one holds; nulls don't, and of nothing none does."""
    return F.coalesce(F.bool_or(x), F.lit(False))


def all_of(x: Column) -> Column:
    """Whether all hold; nulls aren't counted, and of nothing all do."""
    return F.coalesce(F.bool_and(x), F.lit(True))


def none_of(x: Column) -> Column:
    """Whether none holds."""
    return ~any_of(x)


def replace_delay(v: Column, default: Column | int) -> Column:
    """A default for a delay."""
    return F.when(v == DELAY, default if isinstance(default, Column) else F.lit(default)).otherwise(v)


def least_of(*vs: Column) -> Column:
    """L1 of values side by side; nulls don't count."""
    return F.least(*vs) if len(vs) > 1 else vs[0]


def most_of(*vs: Column) -> Column:
    """L2 of values side by side; nulls don't count."""
    if len(vs) == 1:
        return vs[0]
    return F.when(reduce(lambda a, b: a | b, [F.coalesce(v == DELAY, F.lit(False)) for v in vs]), F.lit(DELAY)).otherwise(F.greatest(*vs))


def status(v: Column) -> list[Column]:
    """How many are done and delayed, and what that makes of the component."""
    delayed = F.count_if(v == DELAY)
    return [F.count_if(v != DELAY).alias("n_done"), delayed.alias("n_delayed"), F.when(delayed == 0, F.lit("done")).when(F.count_if(v != DELAY) > 0, F.lit("progress")).otherwise(F.lit("delayed")).alias("status")]


#: L13, fixed values: how a property of a variable is merged over branches: (property, operation, value of an empty merge).
MERGE_OPS = [
    ("not_null_expression", "min", 5), ("context_not_null", "max", 0), ("external_not_null", "min_involved", 0), ("in_not_null_context", "max", 0),
    ("context_modified", "context_modified", 0), ("modified_outside_method", "max", 0), ("context_immutable", "max", 0), ("external_immutable", "min_involved", 0), ("immutable", "min", 805),
    ("context_container", "context_container", 1), ("container", "min", 5), ("external_container", "min_involved", 0), ("identity", "min", 1), ("independent", "min", 805), ("ignore_modifications", "min", 5),
]
AGGREGATES = {"min": least, "max": most, "max_ignore_delay": most_ignoring_delay, "min_involved": least_involved, "context_modified": context_modified, "context_container": context_container}


def merge_ops(spark) -> DataFrame:
    """(property, op, seed): the merge table, a small dimension."""
    return spark.createDataFrame(MERGE_OPS, "property string, op string, seed int")


def merge_by_op(rows: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """Values merged per key and property by the property's operation: (keys, property, v); one aggregate for all operations."""
    joined = rows.join(F.broadcast(ops), "property")
    each = joined.groupBy(*keys, "property", "op").agg(*(f(F.col("v")).alias(f"_{name}") for name, f in AGGREGATES.items()))
    pick = reduce(lambda c, name: c.when(F.col("op") == name, F.col(f"_{name}")), AGGREGATES, F.when(F.lit(False), F.lit(0)))
    return each.select(*keys, "property", pick.alias("v"))


def merge_causes(causes: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """Per key the causes of the highest priority, (cause, place) once each at its earliest statement.

    ``causes``: keys, cause, place, stmt, high. With ``cap``, as many per key at most, by (stmt, cause, place); that
    an element is delayed never depends on it.
    """
    from pyspark.sql import Window

    # one aggregate of all causes; what is left is bounded by kinds of cause and places
    once = causes.groupBy(*keys, "cause", "place", "high").agg(F.min("stmt").alias("stmt"))
    if keys:
        once = once.withColumn("_top", F.max("high").over(Window.partitionBy(*keys))).where(F.col("high") == F.col("_top")).drop("_top", "high")
    else:
        once = once.join(F.broadcast(once.agg(F.max("high").alias("high"))), "high").drop("high")
    if cap is None:
        return once
    order = Window.partitionBy(*keys).orderBy("stmt", "cause", "place")
    return once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def merge_outer(a: DataFrame, b: DataFrame, keys: list[str], op=most_of) -> DataFrame:
    """Values of two states side by side; what one lacks is not counted."""
    left, right = a.withColumnRenamed("v", "_a"), b.withColumnRenamed("v", "_b")
    return left.join(right, keys, "full").select(*keys, F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(op(F.col("_a"), F.col("_b"))).alias("v"))

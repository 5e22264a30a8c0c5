"""The rule driver: rules map facts and the state so far to values, round after round, until nothing changes.

A rule is a function ``(facts, state, break_delay) -> DataFrame(elem, property, v)``. A round runs all rules; a value once
known stays, and a rule may leave out elements that the state already knows (:func:`open_elements`). A round is one job:
what ends the loop is counted while the state is written. If a round brings nothing new while there are delays, the next
one may break them (rules then answer what they must guess; such values are marked inconclusive); if that brings
nothing either, the state is final.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lattice import DELAY
from graphloom.staging import written_with

Rule = Callable[[dict[str, DataFrame], DataFrame, bool], DataFrame]
STATE = "elem string, property string, v int, inconclusive boolean, round int"


class NoProgress(RuntimeError):
    """Delays are left after the last round allowed."""


def run_rules(facts: dict[str, DataFrame], rules: list[Rule], spark, max_rounds: int = 100, on_round=None) -> DataFrame:
    """The final state: (elem, property, v, inconclusive, round).

    Several rules may answer for one element and property: the least value of a round counts. ``on_round`` gets
    each round's number and state, for snapshots.
    """
    state = spark.createDataFrame([], STATE)
    breaking = False
    for n in range(max_rounds):
        found = reduce(DataFrame.unionByName, [r(facts, state, breaking).select("elem", "property", F.col("v").cast("int").alias("v")) for r in rules])
        found = found.groupBy("elem", "property").agg(F.min("v").alias("v"))
        old = state.select("elem", "property", F.col("v").alias("_v"), F.col("inconclusive").alias("_i"), F.col("round").alias("_r"))
        known = F.coalesce(F.col("_v"), F.lit(DELAY)) != DELAY
        both = old.join(found, ["elem", "property"], "full")
        v = F.when(known, F.col("_v")).otherwise(F.coalesce("v", F.lit(DELAY)))
        new = both.select("elem", "property", v.alias("v"), F.when(known, F.col("_i")).otherwise(F.lit(breaking) & (v != DELAY)).alias("inconclusive"), F.when(known | (v == DELAY), F.coalesce("_r", F.lit(n))).otherwise(F.lit(n)).alias("round"), (~known & (v != DELAY)).alias("_new"))
        new, told = written_with(new, "state", F.count_if("_new").alias("new"), F.count_if(F.col("v") == DELAY).alias("delayed"))
        state = new.drop("_new")
        if on_round is not None:
            on_round(n, state)
        if not told["delayed"]:
            return state
        if not told["new"]:
            if breaking:
                return state
            breaking = True
        else:
            breaking = False
    raise NoProgress(f"{told['delayed']} values are delayed after {max_rounds} rounds")


class Visitors:
    """K7: what each round left, by kind of element, as a table; pass it as ``on_round``.

    ``kind``: a Column over elem and property that names the kind (type map, type, field, method, statement, variable,
    evaluation); null kinds aren't looked at. A round's counts are one small aggregate of the state that it wrote.
    """

    def __init__(self, kind: Column):
        self.kind, self.seen = kind, []

    def __call__(self, n: int, state: DataFrame) -> None:
        each = state.withColumn("kind", self.kind).where("kind is not null").groupBy("kind", "property")
        self.seen.append(each.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == DELAY).alias("delayed"), F.count_if("inconclusive").alias("inconclusive")).withColumn("round", F.lit(n)))

    def table(self) -> DataFrame:
        """(kind, property, n, delayed, inconclusive, round); refused before the first round."""
        if not self.seen:
            raise ValueError("no round has been seen")
        return reduce(DataFrame.unionByName, self.seen)


def open_elements(elements: DataFrame, state: DataFrame, name: str) -> DataFrame:
    """The elements (elem, ...) whose value of a property isn't known yet: what a rule still has to answer for."""
    known = state.where((F.col("property") == name) & (F.col("v") != DELAY)).select("elem")
    return elements.join(known, "elem", "left_anti")


def value_of(state: DataFrame, name: str, elem: str) -> DataFrame:
    """(elem, v) of one property, under the names asked for: a side of a lookup join."""
    return state.where(F.col("property") == name).select(F.col("elem").alias(elem), F.col("v").alias(name))

"""Linked variables: (ctx, src, dst, w) rows; a context whose links aren't set yet has status ``nys``, which is not the empty set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lattice import DELAY, LINK, value


def merge_links(a: DataFrame, b: DataFrame, keys: list[str], minimum: int | None = None) -> DataFrame:
    """Links of two states; new ones are at least ``minimum``. 0 on either side stays 0, even over a delay; else the least."""
    new = b if minimum is None else b.withColumn("w", F.when(F.col("w") == DELAY, F.lit(DELAY)).otherwise(F.greatest("w", F.lit(minimum))))
    both = a.select(*keys, "w").union(new.select(*keys, "w"))
    return both.groupBy(*keys).agg(F.when(F.bool_or(F.col("w") == 0), F.lit(0)).otherwise(F.min("w")).alias("w"))


def merge_delay(links: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """What is linked in either becomes a delay, but 0 stays."""
    right = others.select(*keys).distinct().withColumn("_o", F.lit(True))
    return links.select(*keys, "w").join(right, keys, "full").select(*keys, F.when(F.col("w") == 0, F.lit(0)).otherwise(F.lit(DELAY)).alias("w"))


def translate(links: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Targets renamed by (old, new); targets that fall together keep the least weight."""
    renamed = links.join(names, F.col("dst") == F.col("old"), "left").withColumn("dst", F.coalesce("new", "dst"))
    return renamed.groupBy(*keys).agg(F.min("w").alias("w"))


# Maps and filters of weights
def at_least(w: Column, minimum: int) -> Column:
    return F.when(w == DELAY, w).otherwise(F.greatest(w, F.lit(minimum)))


def to_delay(w: Column) -> Column:
    return F.when(w == LINK["statically_assigned"], w).otherwise(F.lit(DELAY))


def non_delayed_part(links: DataFrame) -> DataFrame:
    return links.where(F.col("w") != DELAY)


def change_all_to(links: DataFrame, w: int) -> DataFrame:
    return links.withColumn("w", F.lit(w))


def without(links: DataFrame, removed: DataFrame) -> DataFrame:
    return links.join(removed.select(F.col(removed.columns[0]).alias("dst")), "dst", "left_anti")


def compatible_with_immutable(links: DataFrame, immutable: DataFrame) -> DataFrame:
    """Links that immutability allows. ``immutable``: (node, v).

    Nothing is linked to a recursively immutable target but by assignment; a source of level two or more is not
    dependent; as long as either value is a delay the link is one too.
    """
    source, target = immutable.select(F.col("node").alias("src"), F.col("v").alias("_s")), immutable.select(F.col("node").alias("dst"), F.col("v").alias("_t"))
    joined = links.join(source, "src", "left").join(target, "dst", "left")
    top, second = value("recursively_immutable"), value("level2_immutable")
    assigned = F.col("w").isin(LINK["statically_assigned"], LINK["assigned"])
    delayed = (F.coalesce("_s", F.lit(0)) == DELAY) | (F.coalesce("_t", F.lit(0)) == DELAY)
    dropped = (F.coalesce("_t", F.lit(0)) == top) | ((F.col("w") == LINK["dependent"]) & (F.coalesce("_s", F.lit(0)) >= second))
    kept = joined.where(assigned | delayed | ~dropped)
    return kept.select(*[F.when(delayed & ~assigned, F.lit(DELAY)).otherwise(F.col("w")).alias("w") if c == "w" else F.col(c) for c in links.columns])


def link_of_independence(v: Column) -> Column:
    """The link level that an independence value allows."""
    return F.when(v == DELAY, F.lit(DELAY)).when(v == value("independent"), F.lit(LINK["no_link"])).when(v == value("dependent"), F.lit(LINK["dependent"])).otherwise(F.shiftright(v, 3) + LINK["independent1"])


def independence_of_link(w: Column) -> Column:
    """The independence value of a link level."""
    return F.when(w == DELAY, F.lit(DELAY)).when(w >= LINK["no_link"], F.lit(value("independent"))).when(w <= LINK["dependent"], F.lit(value("dependent"))).otherwise((w - LINK["independent1"]) * 8 + 5)

"""Package and type filters as predicates that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def accepts(name: Column, patterns: list[str], dotted: bool = True) -> Column:
    """F12, as usage collection takes it: an exact name, or with a trailing dot everything below it and the name itself.

    ``dotted=False`` is how uploads take it: the dot is stripped first, so ``java.util.`` also accepts ``java.utilx``.
    An empty list accepts nothing here; callers that mean "all" leave the filter out.
    """
    if not dotted:
        return _any([name.startswith(p.rstrip(".")) if p.endswith(".") else name == p for p in patterns])
    below = [p for p in patterns if p.endswith(".")]
    return _any([name.startswith(p) for p in below]) | name.isin([p.rstrip(".") for p in patterns]) if patterns else F.lit(False)


def restricted(types: DataFrame, restrictions: list[str]) -> DataFrame:
    """Source types by package or type; no restriction accepts all. ``types``: package, type_fqn."""
    if not restrictions:
        return types
    return types.where(accepts(F.col("package"), restrictions) | F.col("type_fqn").isin(restrictions))


def preload(types: DataFrame, packages: list[str]) -> DataFrame:
    """The types at or below the packages, as prefix filters that Parquet can use."""
    return types.where(_any([(F.col("package") == p) | F.col("package").startswith(f"{p}.") for p in packages]))


def package_pattern(package: Column, restrictions: list[str]) -> Column:
    """The package filter of annotation files: an exact package, or with a trailing dot all below; none accepts all."""
    return F.lit(True) if not restrictions else accepts(package, restrictions)

"""Spark-first analytics over program graphs: lattice aggregates, graph fixpoints, rules and diagnostics."""

__version__ = "0.1.0"

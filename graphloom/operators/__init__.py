"""Relational, lattice and graph operators."""

"""Queries over the given tables, one for each operator, and the SQL that they are checked against."""

from __future__ import annotations

from importlib import import_module

from strandloom.queries.registry import ORACLES, QUERIES

for _name in ("intervals", "scalars", "series", "arrays", "joins", "aggregates", "stats", "kmers", "calling", "sampling", "sources"):
    import_module(f"strandloom.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]

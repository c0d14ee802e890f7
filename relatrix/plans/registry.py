"""Registered queries by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from . import catalogue, literals

QUERIES = {**catalogue.QUERIES, **literals.QUERIES}
ORACLES = {**catalogue.ORACLES, **literals.ORACLES}

__all__ = ["ORACLES", "QUERIES"]

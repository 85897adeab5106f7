"""Queries of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import inspect

from . import queries
from .oracles import ORACLE_SQL  # noqa: F401

HELPERS = {"read", "rgb", "labelled", "r6"}
QUERIES = {
    name: f for name, f in vars(queries).items() if inspect.isfunction(f) and f.__module__ == queries.__name__ and not name.startswith("_") and name not in HELPERS
}

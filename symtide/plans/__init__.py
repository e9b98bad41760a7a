"""Named queries and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("problems", "reference", "reading", "tools", "upkeep")


def all_queries() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f".{m}", __name__).QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in import_module(f".{m}", __name__).ORACLE.items()}

"""All queries of the engine: importing a module of `plans` registers its queries."""

from __future__ import annotations

from importlib import import_module

from memlake.plans.registry import ORACLES, QUERIES, Query

MODULES = ("agents", "facts", "graph", "memory", "rank")


def _load() -> None:
    for m in MODULES:
        import_module(f"memlake.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    _load()
    return ORACLES

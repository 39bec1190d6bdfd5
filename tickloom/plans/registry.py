"""All registered queries: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("bars", "indicators", "screen", "mining", "trades", "robustness", "costs", "results", "configs", "archives")


def _entries() -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"tickloom.plans.{name}")
        for key, value in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query {key!r} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return {name: fn for name, (fn, _) in _entries().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _entries().items() if sql}

"""The engine's own queries and their SQL."""

from __future__ import annotations

import importlib

from fieldloom.plans import registry

PLANS = ("field", "texts", "passages", "superset", "streams", "declared")


def _load() -> None:
    for name in PLANS:
        importlib.import_module(f"fieldloom.plans.{name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)

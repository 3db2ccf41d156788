"""Registered queries with their SQL twins, and the views both are built on."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    """(queries, oracles) of every ``q_*`` module of this package."""
    from checks import registry

    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            importlib.import_module(f"checks.{info.name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)

"""Named queries over the shared test tables, with equivalent SQL."""

from __future__ import annotations

import importlib

from .core import QUERIES, SQL

MODULES = ("q_tables", "q_windows", "q_bundles", "q_outcomes")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)

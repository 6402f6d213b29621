"""Registered queries over the test tables and the SQL each is checked with."""

from __future__ import annotations

import importlib

from hinloom.catalog.base import Run

_AREAS = ["network", "algebra", "vectors", "quality", "learning", "sparse", "topics"]


def _catalogs():
    for area in _AREAS:
        yield importlib.import_module(f"hinloom.catalog.{area}").catalog


def all_queries() -> dict[str, Run]:
    return {name: run for c in _catalogs() for name, run in c.runs.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for c in _catalogs() for name, sql in c.sql.items()}

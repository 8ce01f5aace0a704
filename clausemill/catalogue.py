"""All queries of the core, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("documents", "clauses", "finding")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"clausemill.plans.{name}"), what))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")

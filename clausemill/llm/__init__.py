"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

MODULES = (
    "p1_scan_noise",
    "p2_near_records",
    "p3_canonical",
    "p4_history",
    "p5_neighbours",
    "p6_tokens",
    "p7_leaks",
    "p8_truncation",
)


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{name}"), what)())
    return out


def queries() -> dict:
    return _gather("queries")


def oracle_sql() -> dict:
    return _gather("oracle_sql")

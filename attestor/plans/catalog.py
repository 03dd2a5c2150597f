"""All queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

#: Modules of this package with QUERIES {name: f(spark, sf_dir)} and ORACLE {name: SQL}.
MODULES = ["evidence", "policy", "scoring", "layout", "linking", "text", "repairs", "extract", "recovery"]


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")

"""All queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import importlib

#: Modules of this package with QUERIES and ORACLE.
MODULES = ("best", "damage", "groups", "leaks", "neighbours", "overlaps", "tokens")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"darkslide.llm.{m}"), name))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")

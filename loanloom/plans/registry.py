"""All registered queries of the loan side, by family."""

from __future__ import annotations

import importlib

#: Modules of this package that hold QUERIES (name -> callable) and ORACLE (name -> SQL).
FAMILIES: list[str] = ["credit", "monitoring", "compliance", "decisions", "listings", "resolution", "documents", "provenance", "validations", "records", "intake", "texts", "evaluation"]


def queries() -> dict:
    found: dict = {}
    for name in FAMILIES:
        found.update(importlib.import_module(f"loanloom.plans.{name}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in FAMILIES:
        found.update(importlib.import_module(f"loanloom.plans.{name}").ORACLE)
    return found

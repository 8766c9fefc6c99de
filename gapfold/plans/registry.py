"""All queries of the core, and their SQL."""

from __future__ import annotations

import importlib

MODULES = [f"gapfold.plans.{m}" for m in ("data", "profiles", "points", "grids", "voxels", "leaf")]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= importlib.import_module(m).SQL
    return out

"""Every registered query and its oracle SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("library", "ranking", "scoring", "studies", "extras", "transitions")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"strandex.plans.{name}"), what)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"{name} repeats {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")

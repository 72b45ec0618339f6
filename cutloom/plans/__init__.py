"""Queries on the test tables; importing a module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("editing", "signals", "text", "ingest", "binary", "streams", "pieces")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"cutloom.plans.{name}")

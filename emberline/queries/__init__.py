"""Registered queries over the canonical views, each with its SQL twin."""

from __future__ import annotations

import importlib

from .registry import ORACLE_SQL, QUERIES

MODULES = ("broker", "core", "temporal", "market", "signals", "intel", "rollups", "battles", "assess", "chain", "entities", "archives", "anomaly")


def load():
    """The registered queries and their SQL twins."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLE_SQL

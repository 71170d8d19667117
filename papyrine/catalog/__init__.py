"""Registered queries: each runs an operator over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from papyrine.catalog.registry import ORACLES, QUERIES

for _name in ("searching", "cleaning", "queues", "reports", "matching", "changes", "publishing", "incremental"):
    import_module(f"papyrine.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]

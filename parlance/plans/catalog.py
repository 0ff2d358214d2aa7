"""Importing this module registers every query."""

import importlib

from parlance.plans.registry import QUERIES, SQL

for _module in ("voice", "assembly", "text", "casing", "alignment", "live", "service", "streams"):
    importlib.import_module(f"parlance.plans.{_module}")

__all__ = ["QUERIES", "SQL"]

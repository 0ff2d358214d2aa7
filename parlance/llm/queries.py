"""Importing this module registers the queries of all corpus operators."""

import importlib

from parlance.llm.registry import QUERIES, SQL

for _module in ("bestfit", "bpe", "cosine", "language", "merkle", "neighbours", "packing", "phrases", "quality", "repeats", "secrets", "sharding", "simhash"):
    importlib.import_module(f"parlance.llm.{_module}")

__all__ = ["QUERIES", "SQL"]

"""Queries of the subpackage (merged by ``__spark_entry__``) and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MODULES = ("exact_dedup", "decontaminate", "language_id", "near_dedup", "packing", "pii", "secrets", "url_filter",
           "substring_dedup", "suffix_dedup", "filter_audit", "quality",
           "prefix_trie")


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")

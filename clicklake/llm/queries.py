"""All queries of this subpackage, with their oracles."""

from __future__ import annotations

import importlib

MODULES = ("near_duplicates", "top_n", "seen_before", "term_counts", "tokens", "packing", "quality")


def registered(what: str) -> dict:
    """QUERIES or ORACLES of every module, merged."""
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"clicklake.llm.{name}"), what)
    return out

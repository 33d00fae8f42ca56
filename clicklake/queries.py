"""All queries of the core, with their oracles, by name."""

from __future__ import annotations

import importlib

MODULES = ("operators.rolling", "operators.sessions", "operators.asof_intervals", "operators.lists", "operators.features", "operators.windows", "operators.bias", "operators.evaluation", "operators.lexical", "operators.vectors", "operators.candidates", "operators.sketches", "operators.postings", "operators.ranking", "operators.relational", "operators.matching", "streaming.counters", "sources.formats")


def registered(what: str) -> dict:
    """QUERIES or ORACLES of every module, merged; a name may be taken once."""
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"clicklake.{name}"), what).items():
            if key in out:
                raise ValueError(f"{key} is defined twice")
            out[key] = value
    return out

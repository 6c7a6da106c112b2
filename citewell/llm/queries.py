"""Registered queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

OPERATORS = (
    "mixing", "packing", "fingerprints", "linededup", "quality", "toxicity", "neardup", "vectors", "personal", "webtext",
    "trie", "bestfit", "resampling",
)


def registry() -> dict:
    """The query modules by operator; an operator without a module is an import error, never a silent gap."""
    out: dict = {}
    for name in OPERATORS:
        out.update(importlib.import_module(f"citewell.llm.q_{name}").QUERIES)
    return out

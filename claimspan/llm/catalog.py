"""All queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: Modules of this package with QUERIES and ORACLES.
MODULES = ("sentence_queries", "copies_queries", "overlap_queries", "splitting_queries", "token_queries", "abuse_queries")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").ORACLES.items()}

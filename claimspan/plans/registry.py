"""All core queries and their SQL, by name."""

from __future__ import annotations

import importlib

#: Modules of this package with QUERIES and ORACLES.
MODULES = ("integrity", "nested", "texts", "search", "passages", "claims", "loading", "structure", "reports", "rollups")


def core_queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def core_oracles() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").ORACLES.items()}

"""All reference queries with their SQL."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _name in ("scans", "temporal", "groups", "joins", "ordered", "rasters", "models", "extras"):
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]

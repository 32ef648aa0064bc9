"""Queries of this subpackage, by name."""

from __future__ import annotations

from . import queries

QUERIES = dict(queries.QUERIES)
ORACLES = dict(queries.ORACLES)

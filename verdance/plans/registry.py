"""Registration of queries beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.adapters import SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, uses: str = "", more: str = "", recursive: bool = False):
    """Register a function; ``uses`` names the shapes that ``sql`` reads, ``more`` further WITH parts."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [SQL[u] for u in uses.split()] + ([more] if more else [])
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else "") + sql
        return f

    return add


def r6(x: Column | str, places: int = 6) -> Column:
    """Rounded to six decimals, as on the SQL side.

    Values that are exact short decimals need more places: the engines round halves differently.
    """
    return F.round(F.col(x) if isinstance(x, str) else x, places)


def r10(x: Column | str) -> Column:
    return r6(x, 10)

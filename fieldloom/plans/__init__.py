"""The library's queries over the given tables, and their SQL."""

from __future__ import annotations

from . import cases, extraction, records

_PARTS = (extraction, records, cases)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}

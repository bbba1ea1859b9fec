"""All queries of the linkage engine, and their SQL."""

from __future__ import annotations

from . import evidence, linkage, reasoning, records, runs

PARTS = (linkage, evidence, records, reasoning, runs)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}

"""All registered queries of the time-series operators."""

from __future__ import annotations

from tempoweave.catalog import Query, markers, naming, quality, scans

FAMILIES = (markers.C, naming.C, quality.C, scans.C)


def queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, query in family.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.statements.items()}

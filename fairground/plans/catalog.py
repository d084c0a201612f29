"""All queries by name, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from fairground.plans import booth, identity, kiosk, looks, ordered, reports, scans, scoped, spatial, streams, tracking

_MODULES = (booth, kiosk, ordered, spatial, tracking, reports, identity, looks, streams, scans, scoped)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

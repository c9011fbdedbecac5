"""All registered queries of the visibility operators and their DuckDB oracles."""

from __future__ import annotations

from . import audit_queries, discussion_queries, ingest_queries, planning_queries, scan_queries, search_queries

_PARTS = [audit_queries, search_queries, scan_queries, planning_queries, ingest_queries, discussion_queries]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}

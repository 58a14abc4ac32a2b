"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from . import queries, queries_linear

QUERIES = queries.QUERIES | queries_linear.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | queries_linear.ORACLE_SQL

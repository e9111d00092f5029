"""Named queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from sievelake.plans import record_queries, table_queries, text_queries

QUERIES: dict = text_queries.QUERIES | table_queries.QUERIES | record_queries.QUERIES
ORACLE_SQL: dict[str, str] = text_queries.ORACLE_SQL | table_queries.ORACLE_SQL | record_queries.ORACLE_SQL

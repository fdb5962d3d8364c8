"""Names of the registered queries, their functions and their SQL statements."""

from __future__ import annotations

from failscope.plans import source_queries, trace_queries, trace_sql

QUERIES: dict = {**trace_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict = {**trace_sql.ORACLES, **source_queries.ORACLES}

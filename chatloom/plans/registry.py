"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from chatloom.plans import q_change, q_collection, q_retrieval, q_text, q_upkeep, q_views

_MODULES = (q_retrieval, q_text, q_collection, q_change, q_upkeep, q_views)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

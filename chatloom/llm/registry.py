"""Registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from chatloom.llm import queries, sql

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op") and name[2].isdigit()}
ORACLE_SQL = {name: getattr(sql, name) for name in QUERIES if hasattr(sql, name)}

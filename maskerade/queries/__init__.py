"""Registered queries over the driver's tables, each with an independent DuckDB oracle where SQL can say it."""

from __future__ import annotations

from . import documents, preparation, requests, sessions, spans, templates, whole

QUERIES = templates.QUERIES | documents.QUERIES | spans.QUERIES | sessions.QUERIES | preparation.QUERIES | whole.QUERIES | requests.QUERIES
ORACLE_SQL = templates.ORACLE_SQL | documents.ORACLE_SQL | spans.ORACLE_SQL | sessions.ORACLE_SQL | preparation.ORACLE_SQL | whole.ORACLE_SQL | requests.ORACLE_SQL
flagship = documents.label_counts

"""Queries over the driver's tables and the SQL that each must agree with."""

from __future__ import annotations

from . import document_queries, job_queries, ledger_queries

_MODULES = (ledger_queries, document_queries, job_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

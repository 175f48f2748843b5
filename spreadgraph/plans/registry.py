"""Registered queries and their SQL."""

from __future__ import annotations

from spreadgraph.plans import study, study_sql


def queries():
    return study.queries()


def oracle_sql():
    return study_sql.oracle_sql()

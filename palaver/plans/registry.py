"""Collects the queries of the plan modules."""

from __future__ import annotations

from palaver.plans import analytics, conversations, corpus, lineage, rules

_MODULES = (conversations, corpus, analytics, rules, lineage)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}

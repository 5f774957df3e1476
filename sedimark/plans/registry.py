"""The queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from sedimark.plans import code_index, code_plans, log_plans, relation_plans, source_plans, text_plans

_PLANS = (code_index, text_plans, log_plans, relation_plans, source_plans, code_plans)


def queries() -> dict:
    return {name: f for plans in _PLANS for name, f in plans.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in _PLANS for name, sql in plans.SQL.items()}

"""Queries over the driver's tables: each operator on Spark, next to the same result in plain SQL.

The driver has no invoices, so invoice tables are derived from orders and line items with integer arithmetic, once with
DataFrames (``tables``) and once in SQL (``ctes``). Amounts are integer cents, so the 0.01 tolerance is 1.
"""

from __future__ import annotations

CENT = 1
CHECKS: dict[str, tuple] = {}


def check(name: str, sql: str | None = None):
    """Registers a query under ``name`` with its SQL; queries without SQL are tested on small fixtures instead."""
    def register(fn):
        if name in CHECKS:
            raise ValueError(f"duplicate query {name}")
        CHECKS[name] = (fn, sql)
        return fn
    return register

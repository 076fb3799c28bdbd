"""All named queries of the core and their SQL."""

from __future__ import annotations

from phonolake.plans import register
from phonolake.plans import report_queries, signal_queries, text_queries  # noqa: F401  (they register their queries)


def queries() -> dict[str, register.Query]:
    return dict(register.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(register.SQL)

"""All queries of the engine itself, with the SQL of those that have some."""

from __future__ import annotations

from . import answering, connecting, evaluating, handling, modelling, reasoning, searching  # noqa: F401  they list their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

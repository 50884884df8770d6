"""All queries of the library over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from gleanwork.plans import corpus, retrieval, texts  # noqa: F401  they register their queries
from gleanwork.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""All registered queries."""

from __future__ import annotations

from tickerloom.plans import (  # noqa: F401
    forecast_queries,
    market_queries,
    news_queries,
    portfolio_queries,
    series_queries,
    stream_queries,
)
from tickerloom.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

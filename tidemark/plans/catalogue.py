"""All queries of the library: importing a module of queries registers them."""

from __future__ import annotations

from . import finance_queries, market_queries, news_queries, rule_queries, series_queries, stream_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "finance_queries", "market_queries", "news_queries", "rule_queries", "series_queries", "stream_queries"]

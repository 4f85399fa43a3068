"""Queries over the driver's tables by name, each with SQL that says the same where SQL can."""

from __future__ import annotations

from . import feed_queries, more_queries, panel_queries, rule_queries, sector_queries, series_queries, store_queries, sync_queries, take_queries, text_queries, view_queries

PARTS = (series_queries, text_queries, store_queries, more_queries, rule_queries, panel_queries, feed_queries, view_queries, take_queries, sector_queries, sync_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
FLAGSHIP = "gauge_by_session"

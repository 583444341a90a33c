"""All named queries of the library, with the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import checks, derivatives, desk, evidence, filings, graphs, ingest, licences, market, models, portfolio, regimes, research, stats, strategies, text, windows

FLAGSHIP = "stats_sectors"
TOPICS = (windows, stats, text, market, models, research, portfolio, regimes, derivatives, graphs, evidence, filings, strategies, desk, licences, ingest)

QUERIES: dict = {name: query for topic in TOPICS for name, query in topic.QUERIES.items()}
ORACLE_SQL: dict = {name: text for topic in (*TOPICS, checks) for name, text in topic.ORACLE_SQL.items()}

"""All registered queries of the factor jobs and their SQL."""

from __future__ import annotations

from . import graph_queries, market_queries, text_queries

FLAGSHIP = "region_shock_customers"
QUERIES = graph_queries.QUERIES | market_queries.QUERIES | text_queries.QUERIES
ORACLES = graph_queries.ORACLES | market_queries.ORACLES | text_queries.ORACLES

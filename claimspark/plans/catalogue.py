"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspark.plans import claim_queries, data_queries, history_queries, record_queries, review_queries, search_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **record_queries.QUERIES, **review_queries.QUERIES, **claim_queries.QUERIES, **data_queries.QUERIES, **history_queries.QUERIES, **search_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **record_queries.ORACLES, **review_queries.ORACLES, **claim_queries.ORACLES, **data_queries.ORACLES, **history_queries.ORACLES, **search_queries.ORACLES}
FLAGSHIP = "audit_rows"

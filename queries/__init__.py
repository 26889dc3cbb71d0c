"""Registered queries and their SQL twins."""

from queries import base
from queries import row_queries, traffic_queries, profile_queries, table_queries, model_queries, stream_queries  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES

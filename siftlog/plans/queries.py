"""The registered log-analytics queries and their SQL."""

from siftlog.plans import axis_queries, base_queries, corpus_queries, join_queries, stream_queries, text_queries  # noqa: F401
from siftlog.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

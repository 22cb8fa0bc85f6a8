"""Whole plans and the queries that show each operator on the given tables."""

from . import features, join_queries, model_queries, quality_queries, table_queries, text_queries, window_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

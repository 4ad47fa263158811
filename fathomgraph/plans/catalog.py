"""All registered queries."""

from . import feature_queries, graph_queries, span_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

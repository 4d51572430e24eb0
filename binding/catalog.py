"""Imports every query module so that the registry is complete."""

from binding import statement_queries, model_queries, source_queries, graph_queries, filing_queries, stream_queries  # noqa: F401,I001
from binding.registry import REGISTRY

NAMES = list(REGISTRY)

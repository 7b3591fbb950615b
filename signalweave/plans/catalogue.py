"""The catalogue of named queries and their SQL equivalents."""

from signalweave.plans import collection_queries, diagnostic_queries, evidence_queries, function_queries, generation_queries, greedy_queries, identity_queries, line_queries, provider_queries, record_queries, review_queries, series_queries, stream_queries, text_queries, vector_queries
from signalweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "collection_queries", "diagnostic_queries", "evidence_queries", "function_queries", "generation_queries", "greedy_queries", "identity_queries", "line_queries", "provider_queries", "record_queries", "review_queries", "series_queries", "stream_queries", "text_queries", "vector_queries"]

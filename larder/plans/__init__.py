"""Registered queries: each operator's shape over the driver's tables, with its SQL."""

from larder.plans import audit_queries, brief_queries, photo_queries, queries, sheet_queries

__all__ = ["audit_queries", "brief_queries", "photo_queries", "queries", "sheet_queries"]

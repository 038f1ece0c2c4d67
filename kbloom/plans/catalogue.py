"""All queries of the library."""

from __future__ import annotations

from kbloom.plans import document_queries, display_queries, page_queries, record_queries, registry, score_queries, site_queries, store_queries, text_queries, url_queries  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

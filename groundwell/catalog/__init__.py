"""Every runnable query, with the SQL that states its result where SQL can."""

from groundwell.catalog import conversation, documents, flows, long_term, publishing, quality, retrieval, streams, vectors  # noqa: F401
from groundwell.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

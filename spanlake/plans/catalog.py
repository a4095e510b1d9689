"""All registered queries and their SQL."""

from spanlake.plans import scoring_queries, assembly_queries, ingest_queries, file_queries  # noqa: F401, I001 - SQL blocks build on each other
from spanlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

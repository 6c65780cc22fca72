"""All registered queries; importing a query module registers its queries."""

from factorloom.plans import (  # noqa: F401
    factor_queries,
    ingest_queries,
    label_queries,
    library_queries,
    model_queries,
    portfolio_queries,
    rotation_queries,
    scan_queries,
    screening_queries,
    streaming_queries,
)
from factorloom.plans.registry import QUERIES

__all__ = ["QUERIES"]

"""All registered queries; importing this module registers them."""

from gridloom.plans import (  # noqa: F401
    queries_base,
    queries_domain,
    queries_models,
    queries_series,
    queries_streams,
    queries_text,
)
from gridloom.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]

"""All registered queries."""

from workload import (  # noqa: F401
    carrier_queries,
    construct_queries,
    risk_queries,
    study_queries,
    voyage_queries,
)
from workload.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

"""All registered queries; importing the query modules fills the registry."""

from fraudloom.plans import (  # noqa: F401
    queries_detect,
    queries_groups,
    queries_io,
    queries_maintain,
    queries_reports,
    queries_rows,
    queries_shop,
    queries_stream,
)
from fraudloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

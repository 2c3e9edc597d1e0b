"""All registered queries."""

from furlong.plans import queries_history, queries_ingest, queries_joins, queries_quality, queries_records  # noqa: F401
from furlong.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

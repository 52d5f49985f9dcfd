"""Registered queries."""

from seamwatch.plans import capture_queries, curation_queries, recognition_queries, sensor_queries  # noqa: F401
from seamwatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

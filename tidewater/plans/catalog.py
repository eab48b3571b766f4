"""Imports every plan module so that its queries are registered."""

from tidewater.plans import fleet, market, projections, stats, streams, tables  # noqa: F401
from tidewater.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries: each runs library operators over the driver tables."""

from catalog.base import ORACLES, QUERIES
from catalog import aggregates, forecasts, functions, joins, metrics, models, quality, repair, serving, sources, streams, windows

__all__ = ["QUERIES", "ORACLES"]

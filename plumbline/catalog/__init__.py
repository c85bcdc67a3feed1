"""The named queries over the operators, and their SQL."""

from plumbline.catalog.base import QUERIES, SQL
from plumbline.catalog import cleaning, inference, quality, relations, statistics, text, timeseries  # noqa: F401

__all__ = ["QUERIES", "SQL"]

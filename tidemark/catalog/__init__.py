"""Registered queries; importing the package registers all of them."""

from tidemark.catalog import campaign, events, inference, intervals, relations, reports, signals, spectral, stats, summaries  # noqa: F401
from tidemark.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]

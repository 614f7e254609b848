"""Tape-verified corporate-action analytics on Spark: claims, factors, guards, breaks, feeds, reconciliation, identity."""

__version__ = "0.1.0"

"""The engine's SQL dialect, rewritten to Spark SQL before parsing."""

from .rewrite import Rewriter, Rewritten

__all__ = ["Rewriter", "Rewritten"]

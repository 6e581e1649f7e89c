"""Corpus search, symbol, reference, diff and change-log queries on Spark."""

from .errors import EngineError

__all__ = ["EngineError"]

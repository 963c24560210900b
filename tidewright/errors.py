"""Errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors raised here."""


class SQLQueryError(EngineError, ValueError):
    """A statement that can't be planned or run."""


class ResultOverflowError(EngineError):
    """More rows than ``collect(limit)`` allows."""

"""Registered queries: one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from . import events, history, reading, relating, scalars, searching, writing
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "events", "history", "reading", "relating", "scalars", "searching", "writing"]

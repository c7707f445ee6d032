"""Registered queries, each with the SQL text that must give the same rows."""

from salestally.checks import analytics, drilling, functions, matching, reconciling, sources, upkeep  # noqa: F401
from salestally.checks.base import CHECKS, SQL

__all__ = ["CHECKS", "SQL"]

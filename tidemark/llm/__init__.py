"""Operators for preparing training data.  Nothing else in the library imports this package."""

from tidemark.llm.catalog import queries
from tidemark.llm.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]

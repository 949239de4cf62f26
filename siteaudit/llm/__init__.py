"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from siteaudit.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Relational operators, and one small query for each."""

from .entries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""The 22 decision-support queries as DataFrame plans, and their SQL."""

from .suite import BINDINGS, QUERIES, STANDARD, STANDARD_QUERIES, Q

__all__ = ["BINDINGS", "Q", "QUERIES", "STANDARD", "STANDARD_QUERIES"]

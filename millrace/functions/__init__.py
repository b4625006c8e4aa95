"""Scalar and aggregate expressions the queries share."""

from .exprs import (
    before, between_days, charge_6, cost_4, discount_value_4, exact_ratio, hundredths, money, months_from, moved, profit_4, quotient, revenue_4,
    since, total, total_exact, year_of,
)

__all__ = [
    "before", "between_days", "charge_6", "cost_4", "discount_value_4", "exact_ratio", "hundredths", "money", "months_from", "moved", "profit_4",
    "quotient", "revenue_4", "since", "total", "total_exact", "year_of",
]

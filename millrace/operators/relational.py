"""Relational operators the queries are made of, on any frames.

Thin, declarative compositions: what matters is the shape Catalyst gets to see.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi(left: DataFrame, right: DataFrame, on: Column, residual: Column | None = None) -> DataFrame:
    """EXISTS or IN: rows of ``left`` with a match (for which ``residual`` holds too), once each."""
    return left.join(right, on if residual is None else on & residual, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column, residual: Column | None = None) -> DataFrame:
    """NOT EXISTS: rows of ``left`` without such a match."""
    return left.join(right, on if residual is None else on & residual, "left_anti")


def not_in(left: DataFrame, key: Column, right: DataFrame, other: Column) -> DataFrame:
    """NOT IN: nothing if ``other`` holds a null, and no null keys unless ``right`` is empty."""
    same = key == other
    return left.join(right, same | same.isNull(), "left_anti")


def outer_filtered(left: DataFrame, right: DataFrame, on: Column, keep: Column) -> DataFrame:
    """LEFT OUTER JOIN whose condition on the right side belongs to the join, not to a filter after it."""
    return left.join(right.filter(keep), on, "left")


def per_key(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """A correlated aggregate, once for each key, to join back."""
    return df.groupBy(*keys).agg(value.alias(name))


def one_row(df: DataFrame, value: Column, name: str) -> DataFrame:
    """An uncorrelated scalar subquery, as a frame of one row."""
    return df.agg(value.alias(name))


def having(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], condition: str) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates).filter(condition)


def histogram(df: DataFrame, keys: Sequence[str], count: Column, name: str, frequency: str) -> DataFrame:
    """How many keys have each count: an aggregate of an aggregate."""
    return df.groupBy(*keys).agg(count.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias(frequency))


def sole(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Keys with exactly one distinct non-null value, and that value: least equals greatest."""
    both = df.groupBy(key).agg(F.min(value).alias(name), F.max(value).alias("_greatest"))
    return both.filter(F.col(name) == F.col("_greatest")).drop("_greatest")

"""Spark sessions with the settings the queries are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What every query relies on: UTC days, errors instead of silent nulls, plans that adapt to measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, *, app: str = "millrace", **settings: str) -> SparkSession:
    """A session; ``master`` only for local use (a cluster's launcher sets it)."""
    builder = SparkSession.builder.appName(app)
    own = dict(SETTINGS)
    if master:
        builder = builder.master(master)
        cores = master[6:-1] if master.startswith("local[") else ""
        own["spark.sql.shuffle.partitions"] = cores if cores.isdigit() else str(os.cpu_count() or 8)
        own["spark.ui.enabled"] = "false"
    for k, v in (own | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Input bytes for each partition of a shuffle before adaptive execution joins small ones, and the most partitions.
SHUFFLE_BYTES, MOST_PARTITIONS = 256 << 20, 100_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def partitions_for(size: int, cores: int) -> int:
    """Partitions of a shuffle of up to ``size`` bytes: two rounds of all cores at least."""
    return max(2 * cores, min(MOST_PARTITIONS, -(-size // SHUFFLE_BYTES)))


def fit_shuffles(spark: SparkSession, size: int) -> None:
    """Let shuffles begin with partitions for ``size`` bytes of input; adaptive execution joins those that turn out small,
    but it never makes more than there were. Nothing is changed where the setting was given."""
    if spark.conf.get(_INITIAL, None) is None or getattr(spark, "_millrace_fitted", False):
        wanted = partitions_for(size, spark.sparkContext.defaultParallelism)
        spark.conf.set(_INITIAL, max(wanted, int(spark.conf.get(_INITIAL, "1"))))
        spark._millrace_fitted = True

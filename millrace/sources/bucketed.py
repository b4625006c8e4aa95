"""The tables laid out for co-located joins.

``write_bucketed`` stores the tables once, hashed and sorted by the keys they are joined on; queries over
``bucketed_tables`` then join orders with their lines, and parts with their offers, without shuffling either side.
Worth it where the same large tables are queried many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import TABLES, Tables, load_tables, typed

#: What each large table is hashed by: the key of its largest join.
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "partsupp": "ps_partkey", "supplier": "s_suppkey"}


class BucketedTables(Tables):
    """Typed tables from a database of the catalog."""

    def _read(self, name: str) -> DataFrame:
        return typed(self._spark.table(f"{self._path}.{name}"), name)


def write_bucketed(spark: SparkSession, path: str, database: str, buckets: int) -> BucketedTables:
    """Store the tables below ``path`` in ``database``, the large ones in ``buckets`` files each or a multiple.

    The same number for all, so that any two of them can be joined bucket by bucket; choose it so that a bucket of the
    largest table fits a task.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    own = load_tables(spark, path)
    for name in (*TABLES, "partsupp"):
        raw = spark.read.parquet(f"{path}/{name}.parquet") if name != "partsupp" else _offers(own.partsupp)
        key = KEYS.get(name)
        target = f"{database}.{name}"
        if key:
            raw.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(target)
        else:
            raw.write.mode("overwrite").saveAsTable(target)
    return bucketed_tables(spark, database)


def _offers(partsupp: DataFrame) -> DataFrame:
    """partsupp with its cost as an amount, whether it was read or derived."""
    if "ps_supplycost" not in partsupp.columns:
        partsupp = partsupp.selectExpr("ps_partkey", "ps_suppkey", "ps_availqty", "CAST(CAST(ps_supplycost_c AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(15,2)) AS ps_supplycost")
    return partsupp.select("ps_partkey", "ps_suppkey", "ps_availqty", "ps_supplycost")


def bucketed_tables(spark: SparkSession, database: str) -> BucketedTables:
    return BucketedTables(spark, database)

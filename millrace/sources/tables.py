"""The eight tables, typed.

Each is one Parquet file or folder. Columns the star schema has and the files lack are
derived from keys by integer arithmetic, so any SQL engine can derive the same (see
``plans.oracle``); where the files have them, they are read. Amounts also come as
hundredths (``_c``), and days as dates and as stored (``_at``). Everything is lazy: a query reads the columns it uses.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.exprs import hundredths
from ..session import fit_shuffles

#: Columns each file must have, and those derived if absent.
TABLES: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ),
}
_MONEY = {
    "supplier": ("s_acctbal",), "customer": ("c_acctbal",), "orders": ("o_totalprice",), "partsupp": ("ps_supplycost",),
    "lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
}
_DAYS = {"orders": ("o_orderdate",), "lineitem": ("l_shipdate", "l_commitdate", "l_receiptdate")}


def _numbered(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _pick(number: Column, *names: str) -> Column:
    out = F.when(number == 0, names[0])
    for k, name in enumerate(names[1:-1], 1):
        out = out.when(number == k, name)
    return out.otherwise(names[-1])


def _derived() -> dict[str, dict[str, Column]]:
    ship = F.col("l_shipdate").cast("date")
    order, line, part_ = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p_partkey")
    return {
        "lineitem": {
            "l_commitdate": F.date_add(ship, ((order * 7 + line * 11) % 61 - 20).cast("int")),
            "l_receiptdate": F.date_add(ship, ((order * 13 + F.col("l_partkey")) % 30 + 1).cast("int")),
            "l_shipmode": _pick((order + line) % 7, "MAIL", "FOB", "AIR", "REG AIR", "RAIL", "SHIP", "TRUCK"),
            "l_shipinstruct": _pick((order + line * 2) % 4, "DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"),
        },
        "part": {
            "p_mfgr": _numbered("Manufacturer#", "p_size"),
            "p_container": F.concat(_pick(part_ % 3, "SM ", "MED ", "LG "), _pick((part_ * 5 + F.col("p_size")) % 5, "CASE", "BOX", "PACK", "PKG", "BAG")),
        },
        "customer": {
            "c_address": _numbered("address ", "c_custkey"),
            "c_phone": F.concat((F.col("c_nationkey") + 10).cast("string"), F.lit("-000-000-0000")),
            "c_comment": _numbered("customer comment ", "c_custkey"),
        },
        "supplier": {
            "s_address": _numbered("address ", "s_suppkey"),
            "s_phone": F.concat((F.col("s_nationkey") + 10).cast("string"), F.lit("-000-000-0000")),
            "s_comment": F.when(F.col("s_suppkey") % 10 == 0, "slow Customer noted Complaints").otherwise("quick"),
        },
        "orders": {
            "o_shippriority": F.lit(0),
            "o_comment": F.when(F.col("o_orderkey") % 11 == 0, "special express packages requests").otherwise("regular deposits"),
        },
    }


class MissingColumns(ValueError):
    """A table's file lacks columns that cannot be derived."""


def typed(raw: DataFrame, name: str) -> DataFrame:
    """A table's frame with derived columns, dates and hundredths."""
    missing = [c for c in TABLES.get(name, ()) if c not in raw.columns]
    if missing:
        raise MissingColumns(f"{name}: {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in raw.schema}
    df = raw.withColumns({k: v for k, v in _derived().get(name, {}).items() if k not in kinds})
    own = _DAYS.get(name, ())
    df = df.withColumns({f"{c}_at": F.col(c) for c in own} | {f"{c}_c": hundredths(F.col(c), kinds[c]) for c in _MONEY.get(name, ())})
    return df.withColumns({c: F.col(c).cast("date") for c in own if not isinstance(kinds.get(c, DateType()), DateType)})


def supplied(lineitem: DataFrame) -> DataFrame:
    """partsupp where there is no file: the pairs that were sold, with derived stock and cost."""
    pairs = lineitem.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    stock = (F.col("ps_partkey") * 31 + F.col("ps_suppkey") * 17) % 9999 + 1
    cost = (F.col("ps_partkey") * 7 + F.col("ps_suppkey") * 13) % 99900 + 100
    return pairs.withColumns({"ps_availqty": stock, "ps_supplycost_c": cost})


class Tables:
    """The typed tables below a path, each read when it is first asked for."""

    NAMES = (*TABLES, "partsupp")
    #: Whether partsupp has no file; known once it has been asked for.
    derives_partsupp = False

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self._frames: dict[str, DataFrame] = {}
        self._stamps: dict[str, tuple[int, int] | None] = {}
        self._places: dict[str, tuple] = {}
        self._seen: set[str] = set()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        if name not in self._seen:
            stamp = self._stamp(name)
            if name not in self._frames or stamp != self._stamps[name]:
                self._frames[name], self._stamps[name] = self._read(name), stamp
            self._seen.add(name)
        return supplied(self.lineitem) if name == "partsupp" and self.derives_partsupp else self._frames[name]

    def look_again(self) -> None:
        """When a table is next asked for, see whether its files have changed."""
        self._seen.clear()

    def _stamp(self, name: str) -> tuple[int, int] | None:
        """When a table's file or folder was last changed, and its length; None if there is none."""
        if name not in self._places:
            sc = self._spark.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}.parquet")
            self._places[name] = path.getFileSystem(sc._jsc.hadoopConfiguration()), path
        fs, path = self._places[name]
        try:
            status = fs.getFileStatus(path)
        except Py4JJavaError:
            return None
        return status.getModificationTime(), status.getLen()

    def _read(self, name: str) -> DataFrame | None:
        try:
            found = typed(self._spark.read.parquet(f"{self._path}/{name}.parquet"), name)
        except AnalysisException as e:
            if name != "partsupp" or e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.derives_partsupp = True
            return None
        if name == "partsupp":
            self.derives_partsupp = False
        return found

    def load(self) -> list[str]:
        """Look for all tables now; the names of those that have files."""
        found = []
        for name in TABLES:
            try:
                getattr(self, name)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
            else:
                found.append(name)
        return found

    def size(self) -> int:
        """Bytes of all the tables that have files."""
        leaves = [getattr(self, name)._jdf.queryExecution().analyzed().collectLeaves() for name in self.load()]
        return sum(own.apply(k).stats().sizeInBytes() for own in leaves for k in range(own.size()))

    def views(self) -> None:
        """Register all as temporary views."""
        for name in self.NAMES:
            getattr(self, name).createOrReplaceTempView(name)


def load_tables(spark: SparkSession, path: str) -> Tables:
    """The typed tables below ``path`` (local or any store Spark reads).

    A session lists files and reads schemas of a path once, and again when a table's file or folder has changed. Stores that
    keep no times for folders, and changes further down in partitioned ones, do not show; ``forget`` makes it look again. On a cluster, shuffles
    are then given partitions for the tables' size (``session.fit_shuffles``).
    """
    known = spark.__dict__.setdefault("_millrace_tables", {})
    if path in known:
        known[path].look_again()
    else:
        known[path] = Tables(spark, path)
        if not spark.sparkContext.master.startswith("local"):
            fit_shuffles(spark, known[path].size())
    return known[path]


def forget(spark: SparkSession, path: str | None = None) -> None:
    """Look at the files of ``path`` (or of all paths) anew when they are next asked for."""
    known = spark.__dict__.get("_millrace_tables", {})
    for own in [path] if path else list(known):
        known.pop(own, None)

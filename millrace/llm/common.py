"""Helpers the operators share: reading tables, shipping code, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in one Arrow batch: whole texts travel, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once and keep Arrow batches short.

    The three Arrow settings stay as set here, as queries run after this returns."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "false")
    shared_dir(spark)
    if not getattr(sc, "_millrace_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
        root = os.path.dirname(package)
        target = os.path.join(_own_folder(), "millrace_code.zip")  # the driver serves it to the executors
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, root))
        sc.addPyFile(target)
        sc._millrace_shipped = True
    return spark


def _own_folder() -> str:
    """A temporary folder of this process, deleted when it ends."""
    found = os.path.realpath(tempfile.mkdtemp(prefix="millrace-"))
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


class NoSharedFolder(RuntimeError):
    """On a cluster, neither spark.checkpoint.dir nor a checkpoint folder is set."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given. Where neither is
    set, a local master gets a temporary folder, and any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = getattr(sc, "_millrace_shared", None)
        if not found:
            given = sc._jsc.sc().getCheckpointDir()
            if given.isDefined():
                found = given.get()
            elif sc.master.startswith("local"):
                found = "file:" + _own_folder()
                sc.setCheckpointDir(found)
            else:
                raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
            sc._millrace_shared = found
    return found.rstrip("/")


def _made(spark: SparkSession) -> list[str]:
    """Paths that this package has put into the shared folder and not deleted."""
    return spark.sparkContext.__dict__.setdefault("_millrace_made", [])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for own in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables, graphs, archives and checkpoints that this package has put into the shared folder. Frames
    made before cannot be read any more."""
    made = _made(spark)
    _delete(spark, made)
    made.clear()


def discard(spark: SparkSession, path: str) -> None:
    """Delete one path made by ``fresh_path``."""
    _made(spark).remove(path)
    _delete(spark, [path])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is put into the shared folder inside is deleted at the end; results must be written elsewhere by then."""
    made = _made(spark)
    before = len(made)
    try:
        yield
    finally:
        own, made[before:] = made[before:], []
        _delete(spark, own)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and Spark knows its size."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the shared folder."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _made(spark).append(file.get())
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apart(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


#: Bits of a sieve: at least and at most (4 and 128 megabytes), in between sixteen for each key.
SIEVE_BITS, SIEVE_MOST = 1 << 25, 1 << 30
_ROW_BITS = 1 << 15


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    """Which of a sieve's rows a hashed key falls into, and at which bit."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))
    return F.call_function("div", bit, F.lit(_ROW_BITS).cast("long")), bit % _ROW_BITS


def sift(df: DataFrame, key: Column, keys: DataFrame, of: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key may be among the keys of another table (to be read cheaply, as it is read twice), and those whose key is not.

    The keys' hashes set bits in a table of bounded size, which is broadcast. The second part can so skip a join
    on the key with its shuffle; the first still needs it. With far more keys than the largest table has bits, the first part is everything.
    """
    wanted, size = 16 * keys.count(), SIEVE_BITS
    while size < min(wanted, SIEVE_MOST):
        size *= 2
    row, bit = _place(of, size)
    rows = keys.select(row.alias("_row"), bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at, bits = apart(df, "_row", "_bits")
    rows = written(rows.select(F.col("_row").alias(at), F.col("_bits").alias(bits)), "sieve")
    row, bit = _place(key, size)
    joined = df.join(F.broadcast(rows), row == F.col(at), "left")  # at most SIEVE_MOST
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.call_function("div", bit, F.lit(8).cast("long")) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0, F.lit(False))
    return joined.filter(found).select(*df.columns), joined.filter(~found).select(*df.columns)

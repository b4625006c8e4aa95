"""Results as CSV, and batches of queries by name."""

from __future__ import annotations

import csv
import io
import os
import sys
import time
from collections.abc import Callable, Iterable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


class UnknownQuery(KeyError):
    """No query has this name."""


def format_value(value: object, places: int = 2) -> str:
    """A field: amounts with fixed places, days as YYYY-MM-DD, null as nothing."""
    if value is None:
        return ""
    if isinstance(value, (float, Decimal)):
        return f"{value:.{places}f}"
    if isinstance(value, date):
        return value.strftime("%Y-%m-%d")
    return str(value)


def quote(field: str) -> str:
    """Quote a field that holds a comma, quote, line end or backslash; quotes are doubled."""
    return '"' + field.replace('"', '""') + '"' if any(c in field for c in ',"\n\r\\') else field


def csv_lines(df: DataFrame, places: int = 2) -> Iterable[str]:
    """Header and rows in order, fetched a partition at a time."""
    yield ",".join(df.columns) + "\n"
    for row in df.toLocalIterator():
        yield ",".join(quote(format_value(v, places)) for v in row) + "\n"


def write_csv(df: DataFrame, path: str, *, distributed: bool = False, places: int = 2, out=None) -> None:
    """One local file in the order of the frame, line by line through the driver (and to ``out``); or, distributed, a folder that
    Spark's tasks write, for results that are not meant to be read in one piece."""
    if distributed:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return
    with open(path, "w", newline="") as f:
        for line in csv_lines(df, places):
            f.write(line)
            if out is not None:
                out.write(line)


def read_csv(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text), quotechar='"', doublequote=True))


def run_batch(
    spark: SparkSession, path: str, names: Iterable[str], queries: dict[str, Callable[[SparkSession, str], DataFrame]], *,
    folder: str = ".", out=None, distributed: bool = False, ran: Callable[[str, DataFrame, float, float], None] | None = None,
) -> list[str]:
    """Run queries by name (``q7`` or ``7``) in turn. The k-th goes to result<k>.csv in ``folder`` and to ``out``; if
    ``distributed``, to a folder of that name that Spark's tasks write (``folder`` may then be any URI), and not to ``out``.

    An unknown name is reported in its place and the others still run. ``ran`` is told of each query: its name, its frame, and the seconds
    that planning and running took.
    """
    out = sys.stdout if out is None else out
    files = []
    for k, name in enumerate(names, 1):
        out.write(f"--- query {name} ---\n")
        own = queries.get(name) or queries.get(f"q{name}")
        if own is None:
            out.write(f"Unknown query: {name}\n")
            continue
        target = f"{folder}/result{k}.csv" if distributed else os.path.join(folder, f"result{k}.csv")
        began = time.perf_counter()
        df = own(spark, path)
        planned = time.perf_counter()
        write_csv(df, target, distributed=distributed, out=out)
        if ran is not None:
            ran(name, df, planned - began, time.perf_counter() - planned)
        files.append(target)
    return files

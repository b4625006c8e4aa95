"""CSV results, batches by name, and the driver's contract."""

import io
import os

import pytest
from conftest import DATA
from millrace.plans import QUERIES
from millrace.sources.results import format_value, quote, read_csv, run_batch, write_csv

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("text", ["plain", "a,b", 'say "x"', "two\nlines", "back\\slash", ""])
def test_quoting_round_trip(text):
    assert read_csv(f"{quote(text)},1\n") == [[text, "1"]]


def test_formats():
    from datetime import date

    assert [format_value(v) for v in (None, 1.005, 3, date(1997, 1, 2), "x")] == ["", "1.00", "3", "1997-01-02", "x"]


def test_write_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', 2.5)], "n int, s string, d double")
    write_csv(df, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text() == 'n,s,d\n1,"a ""b""",2.50\n'
    write_csv(df, str(tmp_path / "many"), distributed=True)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "many")).first()[1] == 'a "b"'


def test_batch(spark, tmp_path):
    out = io.StringIO()
    files = run_batch(spark, SF, ["q6", "99", "1"], QUERIES, folder=str(tmp_path), out=out)
    assert [f.rsplit("/", 1)[1] for f in files] == ["result1.csv", "result3.csv"]
    text = out.getvalue()
    assert "--- query q6 ---\nrevenue\n" in text and "Unknown query: 99" in text and text.count("--- query") == 3


def test_batch_tells_times_and_writes_by_tasks(spark, tmp_path):
    told = []
    out = io.StringIO()
    files = run_batch(spark, SF, ["q1", "nope"], QUERIES, folder=str(tmp_path), out=out, distributed=True, ran=lambda *x: told.append(x))
    assert [t[0] for t in told] == ["q1"] and told[0][2] >= 0 and told[0][3] > 0
    assert spark.read.option("header", True).csv(files[0]).count() == 6 and "sum_qty" not in out.getvalue()


def test_trace_counts_rows(spark):
    from millrace.sources import load_tables
    from millrace.trace import report, steps

    df = QUERIES["q1"](spark, SF)
    n = len(df.collect())
    found = steps(df)
    assert any(s.operator.startswith("Scan parquet") and s.rows == load_tables(spark, SF).lineitem.count() for s in found)
    assert any(s.operator == "HashAggregate" and s.rows == n for s in found) and any(s.shuffled for s in found)
    joined = QUERIES["q3"](spark, SF)
    rows = len(joined.collect())
    assert any(s.operator.endswith("Join") and s.rows for s in steps(joined)) and any(s.operator == "Sort" for s in steps(joined))
    assert rows and "rows" in report(joined)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import millrace.__main__ as M

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(M, "session", lambda master: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    monkeypatch.setattr("sys.argv", ["millrace", SF, "--trace"])
    monkeypatch.setattr("sys.stdin", io.StringIO("q6\n14\nstop\nq1\n"))
    M.main()
    got = capsys.readouterr()
    assert "--- query q6 ---" in got.out and "promo_revenue" in got.out and "--- query q1 ---" not in got.out
    assert "q6: planned in" in got.err and "ran in" in got.err and "Scan parquet" in got.err and "all: " in got.err and "load: 7 tables" in got.err


def test_shuffles_fit_the_input(spark):
    from types import SimpleNamespace

    from millrace.session import _INITIAL, fit_shuffles, partitions_for
    from millrace.sources import load_tables

    assert partitions_for(0, 8) == 16 and partitions_for(100 << 30, 8) == 400 and partitions_for(1 << 47, 8) == 100_000
    files = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in "region nation customer supplier part orders lineitem".split())
    assert load_tables(spark, SF).size() == files

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    def fake(**given):
        return SimpleNamespace(conf=Conf(given), sparkContext=SimpleNamespace(defaultParallelism=8))

    one = fake()
    fit_shuffles(one, 100 << 30)
    fit_shuffles(one, 1 << 30)
    assert one.conf[_INITIAL] == 400
    given = fake(**{_INITIAL: "77"})
    fit_shuffles(given, 100 << 30)
    assert given.conf[_INITIAL] == "77"


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert {f"q{k}" for k in range(1, 23)} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_tables_are_listed_again_when_they_change(spark, tmp_path):
    from millrace.sources import forget, load_tables

    path = str(tmp_path / "t")
    spark.createDataFrame([(0, "A")], "r_regionkey int, r_name string").write.parquet(f"{path}/region.parquet")
    first = load_tables(spark, path).region
    assert first.count() == 1 and load_tables(spark, path).region is first
    spark.createDataFrame([(1, "B")], "r_regionkey int, r_name string").write.mode("append").parquet(f"{path}/region.parquet")
    assert load_tables(spark, path).region.count() == 2
    spark.createDataFrame([(2, "C")], "r_regionkey int, r_name string").write.mode("overwrite").parquet(f"{path}/region.parquet")
    assert load_tables(spark, path).region.first()[1] == "C"
    last = load_tables(spark, path)
    forget(spark, path)
    assert load_tables(spark, path) is not last


def test_views(spark):
    from millrace.sources import load_tables

    load_tables(spark, SF).views()
    assert spark.sql("SELECT count(*) FROM lineitem JOIN partsupp ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey").first()[0] == spark.table("lineitem").count()

"""The 22 queries and the operator queries against DuckDB, edge cases on small frames, and the shape of plans."""

import itertools
import re
from datetime import date, timedelta
from types import SimpleNamespace as Q

import duckdb
import pytest
from conftest import DATA
from millrace.operators import ORACLE_SQL as OPERATOR_SQL
from millrace.operators import QUERIES as OPERATORS
from millrace.plans import BINDINGS, QUERIES
from millrace.plans.oracle import ORACLE_SQL
from millrace.plans.suite import PLANS
from millrace.sources.tables import MissingColumns, typed

TABLES = "region nation customer supplier part orders lineitem".split()
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(df, con, sql):
    cur = con.execute(sql)
    rows, names = cur.fetchall(), [d[0] for d in cur.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    ours = sorted(repr(tuple(r[n] for n in order)) for r in df.collect())
    theirs = sorted(repr(tuple(r[names.index(n)] for n in order)) for r in rows)
    assert ours == theirs


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator(spark, duck, name):
    same(OPERATORS[name](spark, SF), duck, OPERATOR_SQL[name])


def sort_keys(sql):
    """Columns that the outermost ORDER BY names, and whether they descend."""
    found = re.search(r"ORDER BY ([^()]*)$", sql)
    return [(k.split()[0], k.upper().endswith("DESC")) for k in found[1].replace("\n", " ").split(", ")] if found else []


def test_every_query_but_those_of_one_row_sorts():
    assert [n for n in QUERIES if not sort_keys(ORACLE_SQL[n])] == ["q6", "q14", "q17", "q19"]


@pytest.mark.parametrize("name", [n for n in QUERIES if sort_keys(ORACLE_SQL[n])] + ["sort_multi_key"])
def test_order(spark, name):
    """Rows come in the order of the SQL: the sort columns, row by row, as DuckDB gives them, and really ordered."""
    path, con = f"{DATA}/sf0.01", duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    sql = (ORACLE_SQL | OPERATOR_SQL)[name]
    cur = con.execute(sql)
    rows, names = cur.fetchall(), [d[0] for d in cur.description]
    keys = sort_keys(sql)
    assert keys
    ours = [tuple(r[k] for k, _ in keys) for r in (QUERIES | OPERATORS)[name](spark, path).collect()]
    assert ours == [tuple(r[names.index(k)] for k, _ in keys) for r in rows]
    assert len(ours) > 1 or name in ("q15",)
    for column in range(len(keys) - 1, -1, -1):  # a stable sort from the last key to the first changes nothing
        rows.sort(key=lambda r, k=names.index(keys[column][0]): r[k], reverse=keys[column][1])
    assert ours == [tuple(r[names.index(k)] for k, _ in keys) for r in rows]


@pytest.mark.parametrize("name", ["q2", "q9", "q11", "q16", "q20"])
def test_pairs_of_unwanted_parts_and_suppliers_are_not_made_distinct(spark, name):
    """Where partsupp is derived, the semi joins lie below the distinct, also if no side can be broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    def depth(line):
        return len(re.match(r"[\s:|+-]*", line)[0])

    pairs = [k for k, x in enumerate(lines) if re.search(r"Aggregate \[ps_partkey#\w+, ps_suppkey#\w+\]", x)]
    assert pairs
    for k in pairs:
        below = itertools.takewhile(lambda x, d=depth(lines[k]): depth(x) > d, lines[k + 1 :])
        assert any("Join LeftSemi" in x for x in below)


DAY = date(1997, 5, 1)
LINE = dict(
    l_orderkey=1, l_partkey=1, l_suppkey=1, l_linenumber=1, l_quantity=1.0, l_extendedprice=100.0, l_discount=0.0, l_tax=0.0, l_returnflag="R", l_linestatus="F",
    l_shipdate=DAY, l_commitdate=DAY, l_receiptdate=DAY, l_shipmode="AIR", l_shipinstruct="DELIVER IN PERSON",
)
ORDER = dict(o_orderkey=1, o_custkey=1, o_orderstatus="F", o_totalprice=1.0, o_orderdate=DAY, o_orderpriority="1-URGENT", o_shippriority=0, o_comment="x")
CUSTOMER = dict(c_custkey=1, c_name="c1", c_nationkey=1, c_acctbal=10.0, c_mktsegment="BUILDING", c_address="a", c_phone="11-0", c_comment="x")
SUPPLIER = dict(s_suppkey=1, s_name="s1", s_nationkey=1, s_acctbal=0.0, s_address="a", s_phone="11-0", s_comment="x")
PART = dict(p_partkey=1, p_name="small ring", p_brand="Brand#13", p_type="PROMO", p_size=8, p_mfgr="m", p_container="MED BOX")
OFFER = dict(ps_partkey=1, ps_suppkey=1, ps_availqty=10, ps_supplycost=1.0)
NATION = dict(n_nationkey=1, n_name="N", n_regionkey=1)
REGION = dict(r_regionkey=1, r_name="R")
DEFAULTS = dict(lineitem=LINE, orders=ORDER, customer=CUSTOMER, supplier=SUPPLIER, part=PART, partsupp=OFFER, nation=NATION, region=REGION)


def tables(spark, **rows):
    """Typed tables of rows given as changes to a default row; one default row where none are given."""
    out = {}
    for name, base in DEFAULTS.items():
        schema = ", ".join(f"{k} {'date' if isinstance(v, date) else 'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in base.items())
        data = [tuple((base | r).values()) for r in rows.get(name, [{}])]
        out[name] = typed(spark.createDataFrame(data, schema), name)
    return Q(**out)


def run(spark, name, literals=None, **rows):
    return [tuple(r) for r in PLANS[name](tables(spark, **rows), Q(**(vars(BINDINGS[name]) | (literals or {})))).collect()]


LATE = dict(l_receiptdate=DAY + timedelta(5))


def test_q21_counts_lines(spark):
    lines = [LATE | {"l_suppkey": 1}, LATE | {"l_suppkey": 1, "l_linenumber": 2}, {"l_suppkey": 2}]
    assert run(spark, "q21", {"nation": "N"}, lineitem=lines, supplier=[{}, {"s_suppkey": 2, "s_name": "s2"}]) == [("s1", 2)]


def test_q21_needs_another_supplier_on_time(spark):
    assert run(spark, "q21", {"nation": "N"}, lineitem=[LATE]) == []
    assert run(spark, "q21", {"nation": "N"}, lineitem=[LATE, LATE | {"l_suppkey": 2}]) == []


@pytest.mark.parametrize("name", ["q6", "q14", "q17", "q19"])
def test_sum_of_nothing_is_null(spark, name):
    assert run(spark, name, lineitem=[]) == [(None,)]


def test_empty_lineitem_gives_no_groups(spark):
    for name in ("q1", "q3", "q5", "q7", "q8", "q9", "q10", "q12", "q15", "q18", "q20", "q21"):
        assert run(spark, name, lineitem=[]) == [], name


def test_groups_that_sum_to_zero_stay(spark):
    free = [{"l_discount": 1.0}]
    assert run(spark, "q5", {"region": "R"}, lineitem=free) == [("N", 0.0)]
    assert [r[2] for r in run(spark, "q10", {"day": "1997-05-01"}, lineitem=free)] == [0.0]
    two = [{}, {"n_nationkey": 2, "n_name": "M"}]
    found = run(spark, "q7", {"one": "N", "other": "M"}, lineitem=free, nation=two, customer=[{"c_nationkey": 2}])
    assert found == [("N", "M", 1997, 0.0)]


def test_q13_counts_customers_without_orders(spark):
    customers = [{}, {"c_custkey": 2}, {"c_custkey": 3}]
    orders = [{}, {"o_orderkey": 2}, {"o_orderkey": 3, "o_custkey": 3, "o_comment": "an express for requests"}]
    assert run(spark, "q13", customer=customers, orders=orders) == [(0, 2), (2, 1)]


def test_q22_keeps_only_customers_without_orders(spark):
    customers = [{"c_acctbal": 1.0, "c_phone": "13-0"}, {"c_custkey": 2, "c_acctbal": 9.0, "c_phone": "13-0"}, {"c_custkey": 3, "c_acctbal": 9.0, "c_phone": "13-0"}]
    assert run(spark, "q22", {"since": None}, customer=customers, orders=[{"o_custkey": 3}]) == [("13", 1, 9.0)]


def test_q4_drops_orders_without_late_lines(spark):
    orders = [{"o_orderdate": date(1996, 9, 1)}, {"o_orderkey": 2, "o_orderdate": date(1996, 9, 1)}]
    assert run(spark, "q4", lineitem=[LATE, LATE], orders=orders) == [("1-URGENT", 1)]


@pytest.mark.parametrize("text,kept", [("expressrequests", False), ("requests express", True), ("express more requests", False), ("", True)])
def test_two_segment_pattern(spark, text, kept):
    found = run(spark, "q13", {"column": "o_comment", "pattern": "%express%requests%"}, orders=[{"o_comment": text}])
    assert found == [(1 if kept else 0, 1)]


def test_date_ranges(spark):
    days = [date(1996, 8, 31), date(1996, 9, 1), date(1996, 11, 30), date(1996, 12, 1)]
    orders = [{"o_orderkey": k, "o_orderdate": d} for k, d in enumerate(days)]
    assert run(spark, "q4", orders=orders, lineitem=[LATE | {"l_orderkey": k} for k in range(4)]) == [("1-URGENT", 2)]


def test_discount_bounds_are_inclusive(spark):
    day = {"l_shipdate": date(1996, 1, 1)}
    lines = [day | {"l_discount": d, "l_extendedprice": p} for d, p in ((0.06, 1.0), (0.07, 10.0), (0.09, 100.0), (0.1, 1000.0), (-0.0, 5.0))]
    assert run(spark, "q6", lineitem=lines) == [(9.7,)]


def test_q15_returns_ties(spark):
    day = {"l_shipdate": date(1996, 2, 1)}
    lines = [day, day | {"l_suppkey": 2}, day | {"l_suppkey": 3, "l_extendedprice": 5.0}]
    suppliers = [{}, {"s_suppkey": 2}, {"s_suppkey": 3}]
    assert [r[0] for r in run(spark, "q15", lineitem=lines, supplier=suppliers)] == [1, 2]


def test_q16_counts_distinct_suppliers(spark):
    found = run(spark, "q16", {"brand": "none", "sizes": (8,), "prefix": "LARGE"}, partsupp=[{}, {}, {"ps_suppkey": 2}])
    assert found == [("Brand#13", "PROMO", 8, 2)]


def test_q17_is_strict(spark):
    lines = [{"l_quantity": 1.0, "l_extendedprice": 7.0}, {"l_quantity": 9.0}]  # 1 is exactly a fifth of the mean
    assert run(spark, "q17", lineitem=lines) == [(None,)]
    assert run(spark, "q17", lineitem=[*lines, {"l_quantity": 9.0}]) == [(1.0,)]


def test_q20_needs_lines(spark):
    assert run(spark, "q20", {"nation": "N"}, lineitem=[{"l_suppkey": 9}]) == []
    assert run(spark, "q20", {"nation": "N"}) == [("s1", "a")]


def test_q11_share(spark):
    offers = [{"ps_supplycost": 0.01, "ps_availqty": 1}, {"ps_partkey": 2, "ps_supplycost": 1.0, "ps_availqty": 100}]
    assert run(spark, "q11", {"nation": "N"}, partsupp=offers) == [(2, 100.0)]


def test_not_in_with_nulls(spark):
    from millrace.operators.relational import not_in
    from pyspark.sql import functions as F

    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some, null, none = (spark.createDataFrame(r, "b int") for r in ([(1,)], [(1,), (None,)], []))
    assert [r[0] for r in not_in(left, F.col("a"), some, F.col("b")).collect()] == [2]
    assert not_in(left, F.col("a"), null, F.col("b")).collect() == []
    assert len(not_in(left, F.col("a"), none, F.col("b")).collect()) == 3


def test_totals_do_not_overflow(spark):
    from millrace.functions import total_exact
    from pyspark.sql import functions as F

    df = spark.range(10).select(F.lit(9_000_000_000_000_000_000).alias("v"))
    assert str(df.agg(total_exact(F.col("v"), 4)).first()[0]) == "9000000000000000.0000"
    assert str(df.agg(total_exact(-F.col("v"), 6)).first()[0]) == "-90000000000000.000000"
    assert str(df.agg(total_exact(F.lit(-7), 2)).first()[0]) == "-0.70"


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingColumns, match="r_name"):
        typed(spark.createDataFrame([(1,)], "r_regionkey int"), "region")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cartesian_products_or_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", ["q6", "q17", "q21"])
def test_one_scan_of_lineitem(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("lineitem.parquet") == 1


def test_scan_reads_only_what_it_needs_and_pushes_filters(spark):
    df = QUERIES["q6"](spark, SF)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    schema = text.split("ReadSchema: ")[1]
    for c in ("l_orderkey", "l_tax", "l_returnflag"):
        assert c not in schema
    assert "LessThan(l_quantity,24.0)" in text and "GreaterThanOrEqual(l_shipdate" in text and "LessThanOrEqual(l_discount" in text

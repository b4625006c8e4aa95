"""One small query for each operator, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import before, between_days, charge_6, exact_ratio, money, moved, profit_4, revenue_4, since, total, year_of
from ..plans.oracle import REV, with_typed
from ..sources.tables import Tables, load_tables
from . import relational as R

col, lit = F.col, F.lit
_found: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}


def _entry(sql: str) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _found[f.__name__] = f, sql
        return f

    return register


@_entry("SELECT l_orderkey, l_partkey, CAST(l_quantity AS DOUBLE) AS quantity FROM t_lineitem")
def scan_project(t):
    return t.lineitem.select("l_orderkey", "l_partkey", col("l_quantity").alias("quantity"))


@_entry("SELECT o_orderkey, o_orderdate FROM t_orders WHERE o_orderdate >= DATE '1996-09-01' AND o_orderdate < DATE '1996-12-01'")
def filter_date_range(t):
    return t.orders.filter(since("o_orderdate", "1996-09-01") & before("o_orderdate", "1996-12-01")).select("o_orderkey", "o_orderdate")


@_entry("SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) + 0.0 AS discount FROM t_lineitem WHERE l_discount BETWEEN 0.08 - 0.01 AND 0.08 + 0.01 AND l_quantity < 24")
def filter_between_decimal(t):
    return t.lineitem.filter(col("l_discount_c").between(7, 9) & (col("l_quantity") < 24)).select("l_orderkey", "l_linenumber", money(col("l_discount_c")).alias("discount"))


@_entry("SELECT l_shipmode, count(*) AS n FROM t_lineitem WHERE l_shipmode IN ('MAIL', 'FOB') GROUP BY l_shipmode")
def filter_in_string(t):
    return t.lineitem.filter(col("l_shipmode").isin("MAIL", "FOB")).groupBy("l_shipmode").agg(F.count(lit(1)).alias("n"))


@_entry("SELECT p_partkey, p_size FROM t_part WHERE p_size IN (22, 18, 10, 14, 50, 7, 6, 25)")
def filter_in_int(t):
    return t.part.filter(col("p_size").isin(22, 18, 10, 14, 50, 7, 6, 25)).select("p_partkey", "p_size")


@_entry("SELECT p_partkey, p_brand FROM t_part WHERE p_brand <> 'Brand#13' AND p_type = 'PROMO'")
def filter_equal_unequal(t):
    return t.part.filter((col("p_brand") != "Brand#13") & (col("p_type") == "PROMO")).select("p_partkey", "p_brand")


@_entry("SELECT p_partkey, p_type FROM t_part WHERE p_type LIKE 'PROMO%'")
def like_prefix(t):
    return t.part.filter(col("p_type").startswith("PROMO")).select("p_partkey", "p_type")


@_entry("SELECT p_partkey, p_type FROM t_part WHERE p_type LIKE '%ARD'")
def like_suffix(t):
    return t.part.filter(col("p_type").endswith("ARD")).select("p_partkey", "p_type")


@_entry("SELECT p_partkey, p_name FROM t_part WHERE p_name LIKE '%ring%'")
def like_infix(t):
    return t.part.filter(col("p_name").contains("ring")).select("p_partkey", "p_name")


@_entry("SELECT o_orderkey, o_orderpriority FROM t_orders WHERE o_orderpriority LIKE '%NOT%SPEC%'")
def like_two_segment(t):
    return t.orders.filter(col("o_orderpriority").like("%NOT%SPEC%")).select("o_orderkey", "o_orderpriority")


@_entry("SELECT p_partkey, p_type FROM t_part WHERE p_type NOT LIKE 'SMALL%'")
def not_like(t):
    return t.part.filter(~col("p_type").startswith("SMALL")).select("p_partkey", "p_type")


@_entry("SELECT l_orderkey, l_linenumber FROM t_lineitem WHERE l_shipdate < l_commitdate AND l_commitdate < l_receiptdate")
def col_col_compare(t):
    return t.lineitem.filter("l_shipdate < l_commitdate AND l_commitdate < l_receiptdate").select("l_orderkey", "l_linenumber")


@_entry("SELECT n1.n_name AS one, n2.n_name AS other FROM nation n1, nation n2 WHERE (n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')")
def or_of_ands(t):
    some = t.nation.filter(col("n_name").isin("NATION_6", "NATION_7"))
    one, other = some.select(col("n_name").alias("one")), some.select(col("n_name").alias("other"))
    return one.join(other, ((col("one") == "NATION_6") & (col("other") == "NATION_7")) | ((col("one") == "NATION_7") & (col("other") == "NATION_6")))


@_entry(f"SELECT l_orderkey, CAST(sum({REV}) AS DOUBLE) AS revenue FROM t_lineitem GROUP BY l_orderkey")
def expr_revenue(t):
    return t.lineitem.groupBy("l_orderkey").agg(total(revenue_4(), 4).alias("revenue"))


@_entry(f"SELECT l_linestatus, CAST(sum({REV} * (1 + l_tax)) AS DOUBLE) AS charge FROM t_lineitem GROUP BY l_linestatus")
def expr_charge(t):
    return t.lineitem.groupBy("l_linestatus").agg(total(charge_6(), 6).alias("charge"))


@_entry(f"SELECT l_suppkey, CAST(sum({REV} - ps_supplycost * l_quantity) AS DOUBLE) AS profit FROM t_lineitem, t_partsupp WHERE ps_partkey = l_partkey AND ps_suppkey = l_suppkey GROUP BY l_suppkey")
def expr_profit(t):
    rows = t.lineitem.join(t.partsupp, (col("l_partkey") == col("ps_partkey")) & (col("l_suppkey") == col("ps_suppkey")))
    return rows.groupBy("l_suppkey").agg(total(profit_4(), 4).alias("profit"))


@_entry("SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, count(*) AS n FROM t_orders GROUP BY 1")
def expr_year(t):
    return t.orders.groupBy(year_of(col("o_orderdate")).alias("o_year")).agg(F.count(lit(1)).alias("n"))


@_entry("SELECT count(*) AS n FROM t_lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '100' DAY AND l_shipdate >= DATE '1996-02-01' + INTERVAL '3' MONTH")
def expr_date_interval(t):
    return t.lineitem.filter(between_days("l_shipdate", moved("1996-02-01", months=3), moved("1998-12-01", days=-100))).agg(F.count(lit(1)).alias("n"))


@_entry("SELECT count(*) AS n FROM t_lineitem WHERE l_shipdate >= CAST('1997-01-01' AS DATE) AND l_shipdate < CAST('1997-01-01' AS DATE) + INTERVAL '1' YEAR")
def expr_date_call(t):
    return t.lineitem.filter("l_shipdate >= date('1997-01-01') AND l_shipdate < date('1997-01-01') + INTERVAL '1' YEAR").agg(F.count(lit(1)).alias("n"))


@_entry('SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS "sum(l_linenumber)", count(*) AS "count(1)", min(l_orderkey) AS "min(l_orderkey)" FROM t_lineitem GROUP BY l_returnflag')
def agg_default_names(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum("l_linenumber"), F.count(lit(1)), F.min("l_orderkey"))


@_entry("SELECT substring(c_phone, 1, 2) AS cntrycode, count(*) AS n FROM t_customer GROUP BY 1")
def expr_substring(t):
    return t.customer.groupBy(F.substring("c_phone", 1, 2).alias("cntrycode")).agg(F.count(lit(1)).alias("n"))


@_entry("SELECT o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS class, count(*) AS n FROM t_orders GROUP BY 1, 2")
def expr_case(t):
    kind = F.when(col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").otherwise("low")
    return t.orders.groupBy("o_orderpriority", kind.alias("class")).agg(F.count(lit(1)).alias("n"))


@_entry("SELECT o_orderkey, c_name FROM t_orders, t_customer WHERE o_custkey = c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_name")


@_entry("SELECT l_orderkey, l_linenumber, CAST(ps_availqty AS BIGINT) AS ps_availqty FROM t_lineitem, t_partsupp WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def join_two_key(t):
    return t.lineitem.join(t.partsupp, (col("l_partkey") == col("ps_partkey")) & (col("l_suppkey") == col("ps_suppkey"))).select("l_orderkey", "l_linenumber", "ps_availqty")


@_entry("SELECT s_name, n_name, r_name FROM t_supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def join_star(t):
    return t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).join(t.region, col("n_regionkey") == col("r_regionkey")).select("s_name", "n_name", "r_name")


@_entry("SELECT c_custkey, s_suppkey FROM t_customer, t_supplier, t_orders, t_lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey")
def join_extra_key(t):
    orders = t.orders.join(t.customer, col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_custkey", "c_nationkey")
    lines = t.lineitem.join(t.supplier, col("l_suppkey") == col("s_suppkey")).select("l_orderkey", "s_suppkey", "s_nationkey")
    return lines.join(orders, (col("l_orderkey") == col("o_orderkey")) & (col("s_nationkey") == col("c_nationkey"))).select("c_custkey", "s_suppkey")


@_entry("SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, count(*) AS n FROM t_orders, t_lineitem, t_customer, t_supplier, nation n1, nation n2 WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey GROUP BY 1, 2")
def join_self_alias(t):
    one = t.nation.select(col("n_nationkey").alias("k1"), col("n_name").alias("supp_nation"))
    other = t.nation.select(col("n_nationkey").alias("k2"), col("n_name").alias("cust_nation"))
    rows = t.lineitem.join(t.supplier.join(one, col("s_nationkey") == col("k1")), col("l_suppkey") == col("s_suppkey"))
    buyers = t.orders.join(t.customer.join(other, col("c_nationkey") == col("k2")), col("o_custkey") == col("c_custkey"))
    return rows.join(buyers, col("l_orderkey") == col("o_orderkey")).groupBy("supp_nation", "cust_nation").agg(F.count(lit(1)).alias("n"))


@_entry("SELECT count(*) AS n FROM t_lineitem, t_part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#14' AND l_quantity <= 11) OR (p_partkey = l_partkey AND p_brand = 'Brand#15' AND l_quantity >= 17)")
def join_disjunctive(t):
    key = col("p_partkey") == col("l_partkey")
    one, other = key & (col("p_brand") == "Brand#14") & (col("l_quantity") <= 11), key & (col("p_brand") == "Brand#15") & (col("l_quantity") >= 17)
    return t.lineitem.join(t.part, one | other).agg(F.count(lit(1)).alias("n"))


@_entry("SELECT c_custkey, count(o_orderkey) AS c_count FROM t_customer LEFT JOIN t_orders ON c_custkey = o_custkey AND o_orderdate >= DATE '2001-01-01' GROUP BY c_custkey")
def join_left_outer_on_filter(t):
    rows = R.outer_filtered(t.customer, t.orders, col("c_custkey") == col("o_custkey"), since("o_orderdate", "2001-01-01"))
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))


@_entry("SELECT o_orderkey FROM t_orders WHERE EXISTS (SELECT * FROM t_lineitem WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate)")
def join_semi_exists(t):
    return R.semi(t.orders, t.lineitem.filter("l_commitdate < l_receiptdate"), col("o_orderkey") == col("l_orderkey")).select("o_orderkey")


@_entry("SELECT o_orderkey, o_custkey FROM t_orders WHERE o_orderkey IN (SELECT l_orderkey FROM t_lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 314)")
def join_semi_in(t):
    large = R.having(t.lineitem, ["l_orderkey"], [F.sum("l_quantity_c").alias("q")], "q > 31400")
    return R.semi(t.orders, large, col("o_orderkey") == col("l_orderkey")).select("o_orderkey", "o_custkey")


@_entry("SELECT l1.l_orderkey, l1.l_suppkey FROM t_lineitem l1 WHERE EXISTS (SELECT * FROM t_lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)")
def join_semi_residual(t):
    one, other = t.lineitem.select("l_orderkey", "l_suppkey"), t.lineitem.select(col("l_orderkey").alias("k"), col("l_suppkey").alias("s"))
    return R.semi(one, other, col("l_orderkey") == col("k"), col("l_suppkey") != col("s"))


@_entry("SELECT c_custkey FROM t_customer WHERE NOT EXISTS (SELECT * FROM t_orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')")
def join_anti_not_exists(t):
    return R.anti(t.customer, t.orders.filter(since("o_orderdate", "2001-01-01")), col("c_custkey") == col("o_custkey")).select("c_custkey")


@_entry("SELECT l1.l_orderkey, l1.l_suppkey FROM t_lineitem l1 WHERE NOT EXISTS (SELECT * FROM t_lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate)")
def join_anti_residual(t):
    late = t.lineitem.filter("l_receiptdate > l_commitdate").select(col("l_orderkey").alias("k"), col("l_suppkey").alias("s"))
    return R.anti(t.lineitem.select("l_orderkey", "l_suppkey"), late, col("l_orderkey") == col("k"), col("l_suppkey") != col("s"))


@_entry("SELECT ps_partkey, ps_suppkey FROM t_partsupp WHERE ps_suppkey NOT IN (SELECT s_suppkey FROM t_supplier WHERE s_comment LIKE '%Customer%Complaints%')")
def join_anti_not_in(t):
    bad = t.supplier.filter(col("s_comment").like("%Customer%Complaints%")).select("s_suppkey")
    return R.not_in(t.partsupp, col("ps_suppkey"), bad, col("s_suppkey")).select("ps_partkey", "ps_suppkey")


@_entry("SELECT c_custkey FROM t_customer WHERE c_acctbal * (SELECT count(*) FROM t_customer WHERE c_acctbal > 0) > (SELECT sum(c_acctbal) FROM t_customer WHERE c_acctbal > 0)")
def scalar_uncorrelated(t):
    rich = t.customer.filter("c_acctbal_c > 0")
    mean = R.one_row(rich, F.sum("c_acctbal_c"), "sum").join(R.one_row(rich, F.count(lit(1)), "n"))
    return t.customer.join(mean, col("c_acctbal_c") * col("n") > col("sum")).select("c_custkey")


@_entry("SELECT ps_partkey, ps_suppkey FROM t_partsupp o WHERE ps_supplycost = (SELECT min(ps_supplycost) FROM t_partsupp i WHERE i.ps_partkey = o.ps_partkey)")
def scalar_correlated_min(t):
    least = R.per_key(t.partsupp, ["ps_partkey"], F.min("ps_supplycost_c"), "least")
    return t.partsupp.join(least, "ps_partkey").filter("ps_supplycost_c = least").select("ps_partkey", "ps_suppkey")


@_entry("SELECT l_orderkey, l_linenumber, o.l_partkey FROM t_lineitem o JOIN (SELECT l_partkey, sum(l_quantity) AS s, count(*) AS n FROM t_lineitem GROUP BY l_partkey) i ON i.l_partkey = o.l_partkey WHERE o.l_quantity * n * 5 < s")
def scalar_correlated_avg(t):
    per = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity_c").alias("s"), F.count(lit(1)).alias("n"))
    return t.lineitem.join(per, "l_partkey").filter("l_quantity_c * n * 5 < s").select("l_orderkey", "l_linenumber", "l_partkey")


@_entry("SELECT ps_partkey, ps_suppkey FROM t_partsupp WHERE ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM t_lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1997-01-01')")
def scalar_correlated_sum(t):
    sold = R.per_key(t.lineitem.filter(since("l_shipdate", "1997-01-01")), ["l_partkey", "l_suppkey"], F.sum("l_quantity_c"), "sold")
    rows = t.partsupp.join(sold, (col("ps_partkey") == col("l_partkey")) & (col("ps_suppkey") == col("l_suppkey")))
    return rows.filter("ps_availqty * 200 > sold").select("ps_partkey", "ps_suppkey")


@_entry(f"WITH r AS (SELECT l_suppkey AS k, sum({REV}) AS v FROM t_lineitem GROUP BY l_suppkey) SELECT k AS l_suppkey, CAST(v AS DOUBLE) AS revenue FROM r WHERE v = (SELECT max(v) FROM r)")
def cte_twice(t):
    per = R.per_key(t.lineitem, ["l_suppkey"], total(revenue_4(), 4), "revenue")
    return per.join(R.one_row(per, F.max("revenue"), "best"), col("revenue") == col("best")).select("l_suppkey", "revenue")


@_entry("SELECT CAST(sum(l_extendedprice * l_discount) AS DOUBLE) AS revenue, count(*) AS n FROM t_lineitem")
def agg_ungrouped(t):
    return t.lineitem.agg(total(col("l_extendedprice_c") * col("l_discount_c"), 4).alias("revenue"), F.count(lit(1)).alias("n"))


@_entry("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(l_quantity) AS DOUBLE) / count(*) AS avg_qty, count(*) AS n FROM t_lineitem GROUP BY 1, 2")
def agg_grouped(t):
    quantity = total(col("l_quantity_c"), 2)
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(quantity.alias("sum_qty"), (quantity / F.count(lit(1))).alias("avg_qty"), F.count(lit(1)).alias("n"))


@_entry("SELECT c_count, count(*) AS custdist FROM (SELECT o_custkey, count(*) AS c_count FROM t_orders GROUP BY o_custkey) GROUP BY c_count")
def agg_of_agg(t):
    return R.histogram(t.orders, ["o_custkey"], F.count(lit(1)), "c_count", "custdist")


@_entry("SELECT p_brand, count(DISTINCT ps_suppkey) AS suppliers FROM t_partsupp, t_part WHERE ps_partkey = p_partkey GROUP BY p_brand")
def agg_count_distinct(t):
    return t.partsupp.join(t.part, col("ps_partkey") == col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("ps_suppkey").alias("suppliers"))


@_entry(f"SELECT l_shipmode, CAST(sum(CASE WHEN l_returnflag = 'R' THEN {REV} ELSE 0 END) AS DOUBLE) / CAST(sum({REV}) AS DOUBLE) AS share FROM t_lineitem GROUP BY l_shipmode")
def agg_conditional(t):
    part = F.when(col("l_returnflag") == "R", revenue_4()).otherwise(lit(0).cast("long"))
    return t.lineitem.groupBy("l_shipmode").agg(exact_ratio(part, revenue_4(), 4).alias("share"))


@_entry("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM t_lineitem WHERE l_receiptdate > l_commitdate GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def agg_min_max_sole(t):
    late = F.when(col("l_receiptdate") > col("l_commitdate"), col("l_suppkey"))
    return R.sole(t.lineitem.select("l_orderkey", late.alias("s")), "l_orderkey", col("s"), "l_suppkey")


@_entry("SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty FROM t_lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200")
def agg_having(t):
    return R.having(t.lineitem, ["l_orderkey"], [F.sum("l_quantity_c").alias("q")], "q > 20000").select("l_orderkey", money(col("q")).alias("sum_qty"))


@_entry("SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM t_supplier ORDER BY s_acctbal DESC, s_name, s_suppkey")
def sort_multi_key(t):
    return t.supplier.select("s_suppkey", "s_name", money(col("s_acctbal_c")).alias("s_acctbal")).orderBy(col("s_acctbal").desc(), "s_name", "s_suppkey")


@_entry("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_totalprice AS VARCHAR) AS price FROM t_orders")
def format_fields(t):
    price = (col("o_totalprice_c").cast("decimal(18,0)") * lit("0.01").cast("decimal(2,2)")).cast("decimal(15,2)").cast("string")
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), price.alias("price"))


def _query(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, path: str) -> DataFrame:
        return f(load_tables(spark, path))

    query.__name__ = f.__name__
    return query


QUERIES = {name: _query(f) for name, (f, _) in _found.items()}
ORACLE_SQL = {name: with_typed(sql) for name, (_, sql) in _found.items()}

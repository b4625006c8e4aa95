"""The 22 queries.

Each takes the tables and its literals (``BINDINGS`` holds those used by default) and
returns a lazy frame; ``STANDARD`` has those of the published workload. Shapes that Catalyst does not find by itself:

* the pairs that stand in for partsupp where it has no file are made of lines that the query can use, not of all;
* q2 and q17 compare with an aggregate of the same rows through a window, not a second scan;
* q10, q13 and q18 aggregate on the key before wide columns or the other side join;
* a side that only selects (a customer's segment, a nation's region) is a semi join, which adds no columns and is no larger than what it selects from;
* q15 joins the largest total back, as a frame of one row;
* q21 asks one aggregate per order for least and greatest supplier, of all lines and of late ones, instead
  of two self-joins.

No join carries a hint: Spark broadcasts a side by its measured size, and otherwise shuffles.

``BINDINGS`` differ from ``STANDARD`` where the tables hold other values. q22 looks for customers without orders since
2001 only: hardly any has none at all, so that over all orders (``since=None``, as in ``STANDARD``) its result would be empty.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace as Q

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import (
    before, between_days, charge_6, cost_4, discount_value_4, exact_ratio, money, months_from, moved, profit_4, revenue_4, since, total, total_exact, year_of,
)
from ..sources.tables import Tables, load_tables, supplied

col = F.col


def _suppliers(t: Tables, nation: str) -> DataFrame:
    return t.supplier.join(t.nation.filter(col("n_name") == nation), col("s_nationkey") == col("n_nationkey"), "left_semi")


def _nations(t: Tables, region: str) -> DataFrame:
    return t.nation.join(t.region.filter(col("r_name") == region), col("n_regionkey") == col("r_regionkey"), "left_semi")


def _offers(t: Tables, *, parts: DataFrame | None = None, sellers: DataFrame | None = None) -> DataFrame:
    """partsupp, of some parts (p_partkey) and suppliers (s_suppkey) only. Where it is derived from lines, those of other
    parts and suppliers are left out before pairs are made distinct, however large the sides are."""
    offers = t.partsupp
    derived = getattr(t, "derives_partsupp", False)
    rows, part, seller = (t.lineitem, "l_partkey", "l_suppkey") if derived else (offers, "ps_partkey", "ps_suppkey")
    if parts is not None:
        rows = rows.join(parts.select("p_partkey"), col(part) == col("p_partkey"), "left_semi")
    if sellers is not None:
        rows = rows.join(sellers.select("s_suppkey"), col(seller) == col("s_suppkey"), "left_semi")
    return supplied(rows) if derived else rows


def q1(t: Tables, p: Q) -> DataFrame:
    rows = t.lineitem.filter(before("l_shipdate", moved(p.day, days=1 - p.days)))
    n = F.count(F.lit(1))

    def mean(name: str):
        return total(col(name), 2) / n

    return (
        rows.groupBy("l_returnflag", "l_linestatus").agg(
            total(col("l_quantity_c"), 2).alias("sum_qty"), total(col("l_extendedprice_c"), 2).alias("sum_base_price"),
            total(revenue_4(), 4).alias("sum_disc_price"), total(charge_6(), 6).alias("sum_charge"), mean("l_quantity_c").alias("avg_qty"),
            mean("l_extendedprice_c").alias("avg_price"), mean("l_discount_c").alias("avg_disc"), n.alias("count_order"),
        ).orderBy("l_returnflag", "l_linestatus")
    )


def q2(t: Tables, p: Q) -> DataFrame:
    parts = t.part.filter((col("p_size") == p.size) & col("p_type").endswith(p.type_end)).select("p_partkey", "p_mfgr")
    sellers = t.supplier.join(_nations(t, p.region), col("s_nationkey") == col("n_nationkey"))
    # Of the pairs of one part in hundreds, the suppliers' fifth is taken when they are joined anyway.
    offers = _offers(t, parts=parts).join(parts, col("ps_partkey") == col("p_partkey")).join(sellers, col("ps_suppkey") == col("s_suppkey"))
    least = F.min("ps_supplycost_c").over(Window.partitionBy("p_partkey"))
    return (
        offers.withColumn("least", least).filter("ps_supplycost_c = least").orderBy(col("s_acctbal_c").desc(), "n_name", "s_name", "p_partkey")
        .select(money(col("s_acctbal_c")).alias("s_acctbal"), "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment")
    )


def q3(t: Tables, p: Q) -> DataFrame:
    buyers = t.customer.filter(col("c_mktsegment") == p.segment).select("c_custkey")
    orders = t.orders.filter(before("o_orderdate", p.day)).join(buyers, col("o_custkey") == col("c_custkey"), "left_semi")
    lines = t.lineitem.filter(since("l_shipdate", moved(p.day, days=1)))
    return (
        lines.join(orders, col("l_orderkey") == col("o_orderkey")).groupBy("l_orderkey", "o_orderdate", "o_shippriority")
        .agg(total(revenue_4(), 4).alias("revenue")).select("l_orderkey", "revenue", "o_orderdate", "o_shippriority")
        .orderBy(col("revenue").desc(), "o_orderdate")
    )


def q4(t: Tables, p: Q) -> DataFrame:
    late = t.lineitem.filter("l_commitdate < l_receiptdate").select("l_orderkey")
    orders = t.orders.filter(months_from("o_orderdate", p.day, 3))
    rows = orders.join(late, col("o_orderkey") == col("l_orderkey"), "left_semi")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority")


def q5(t: Tables, p: Q) -> DataFrame:
    sellers = t.supplier.join(_nations(t, p.region), col("s_nationkey") == col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    orders = t.orders.filter(months_from("o_orderdate", p.day, 12)).join(t.customer, col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = t.lineitem.join(sellers, col("l_suppkey") == col("s_suppkey")).join(orders, (col("l_orderkey") == col("o_orderkey")) & (col("s_nationkey") == col("c_nationkey")))
    return rows.groupBy("n_name").agg(total(revenue_4(), 4).alias("revenue")).orderBy(col("revenue").desc())


def q6(t: Tables, p: Q) -> DataFrame:
    cents = round(p.discount * 100)
    near = col("l_discount").between((cents - 1.5) / 100, (cents + 1.5) / 100)  # a wider range that the scan can skip by
    rows = t.lineitem.filter(months_from("l_shipdate", p.day, 12) & near & col("l_discount_c").between(cents - 1, cents + 1) & (col("l_quantity") < p.quantity))
    return rows.agg(total(discount_value_4(), 4).alias("revenue"))


def q7(t: Tables, p: Q) -> DataFrame:
    both = t.nation.filter(col("n_name").isin(p.one, p.other))
    sellers = t.supplier.join(both, col("s_nationkey") == col("n_nationkey")).select("s_suppkey", col("n_name").alias("supp_nation"))
    buyers = t.customer.join(both, col("c_nationkey") == col("n_nationkey")).select("c_custkey", col("n_name").alias("cust_nation"))
    lines = t.lineitem.filter(between_days("l_shipdate", p.first, p.last))
    orders = t.orders.join(buyers, col("o_custkey") == col("c_custkey")).select("o_orderkey", "cust_nation")
    rows = lines.join(sellers, col("l_suppkey") == col("s_suppkey")).join(orders, col("l_orderkey") == col("o_orderkey")).filter("supp_nation != cust_nation")
    return (
        rows.groupBy("supp_nation", "cust_nation", year_of(col("l_shipdate")).alias("l_year")).agg(total(revenue_4(), 4).alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year")
    )


def q8(t: Tables, p: Q) -> DataFrame:
    parts = t.part.filter(col("p_type") == p.type).select("p_partkey")
    buyers = t.customer.join(_nations(t, p.region), col("c_nationkey") == col("n_nationkey"), "left_semi").select("c_custkey")
    orders = t.orders.filter(between_days("o_orderdate", p.first, p.last)).join(buyers, col("o_custkey") == col("c_custkey"), "left_semi")
    sellers = t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).select("s_suppkey", "n_name")
    rows = (
        t.lineitem.join(parts, col("l_partkey") == col("p_partkey")).join(orders.select("o_orderkey", "o_orderdate"), col("l_orderkey") == col("o_orderkey"))
        .join(sellers, col("l_suppkey") == col("s_suppkey"))
    )
    share = exact_ratio(F.when(col("n_name") == p.nation, revenue_4()).otherwise(F.lit(0).cast("long")), revenue_4(), 4)
    return rows.groupBy(year_of(col("o_orderdate")).alias("o_year")).agg(share.alias("mkt_share")).orderBy("o_year")


def q9(t: Tables, p: Q) -> DataFrame:
    parts = t.part.filter(col("p_name").contains(p.name)).select("p_partkey")
    sellers = t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).select("s_suppkey", col("n_name").alias("nation"))
    offers = _offers(t, parts=parts).select("ps_partkey", "ps_suppkey", "ps_supplycost_c")
    rows = (
        t.lineitem.join(parts, col("l_partkey") == col("p_partkey"), "left_semi")
        .join(offers, (col("l_partkey") == col("ps_partkey")) & (col("l_suppkey") == col("ps_suppkey")))
        .join(t.orders.select("o_orderkey", "o_orderdate"), col("l_orderkey") == col("o_orderkey")).join(sellers, col("l_suppkey") == col("s_suppkey"))
    )
    return (
        rows.groupBy("nation", year_of(col("o_orderdate")).alias("o_year")).agg(total(profit_4(), 4).alias("sum_profit"))
        .orderBy("nation", col("o_year").desc())
    )


def q10(t: Tables, p: Q) -> DataFrame:
    orders = t.orders.filter(months_from("o_orderdate", p.day, 3)).select("o_orderkey", "o_custkey")
    lines = t.lineitem.filter(col("l_returnflag") == p.flag)
    lost = lines.join(orders, col("l_orderkey") == col("o_orderkey")).groupBy("o_custkey").agg(total(revenue_4(), 4).alias("revenue"))
    rows = lost.join(t.customer, col("o_custkey") == col("c_custkey")).join(t.nation, col("c_nationkey") == col("n_nationkey"))
    return rows.select(
        "c_custkey", "c_name", "revenue", money(col("c_acctbal_c")).alias("c_acctbal"), "n_name", "c_address", "c_phone", "c_comment"
    ).orderBy(col("revenue").desc())


def q11(t: Tables, p: Q) -> DataFrame:
    per = _offers(t, sellers=_suppliers(t, p.nation)).groupBy("ps_partkey").agg(total_exact(cost_4(), 4).alias("exact"))
    # The total is one row; it is added up from the groups, whose shuffle Spark reuses.
    all_ = per.agg(F.sum("exact").alias("all"))
    return per.join(all_, col("exact") * p.one_in > col("all")).select("ps_partkey", col("exact").cast("double").alias("value")).orderBy(col("value").desc())


def q12(t: Tables, p: Q) -> DataFrame:
    lines = t.lineitem.filter(col("l_shipmode").isin(*p.modes)).filter("l_commitdate < l_receiptdate AND l_shipdate < l_commitdate")
    rows = lines.filter(months_from("l_receiptdate", p.day, 12)).join(t.orders, col("l_orderkey") == col("o_orderkey"))
    urgent = col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        rows.groupBy("l_shipmode").agg(F.count_if(urgent).alias("high_line_count"), F.count_if(~urgent).alias("low_line_count")).orderBy("l_shipmode")
    )


def q13(t: Tables, p: Q) -> DataFrame:
    orders = t.orders.filter(~col(p.column).like(p.pattern)).groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    per = t.customer.select("c_custkey").join(orders, col("c_custkey") == col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return per.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(col("custdist").desc(), col("c_count").desc())


def q14(t: Tables, p: Q) -> DataFrame:
    rows = t.lineitem.filter(months_from("l_shipdate", p.day, 1)).join(t.part, col("l_partkey") == col("p_partkey"))
    promo = F.when(col("p_type").startswith(p.prefix), revenue_4()).otherwise(F.lit(0).cast("long"))
    return rows.agg((100.0 * total(promo, 4) / total(revenue_4(), 4)).alias("promo_revenue"))


def q15(t: Tables, p: Q) -> DataFrame:
    per = t.lineitem.filter(months_from("l_shipdate", p.day, 3)).groupBy("l_suppkey").agg(total_exact(revenue_4(), 4).alias("exact"))
    best = per.agg(F.max("exact").alias("best"))
    rows = per.join(best, col("exact") == col("best")).join(t.supplier, col("l_suppkey") == col("s_suppkey"))
    return rows.select("s_suppkey", "s_name", "s_address", "s_phone", col("exact").cast("double").alias("total_revenue")).orderBy("s_suppkey")


def q16(t: Tables, p: Q) -> DataFrame:
    parts = t.part.filter((col("p_brand") != p.brand) & ~col("p_type").startswith(p.prefix) & col("p_size").isin(*p.sizes)).select("p_partkey", "p_brand", "p_type", "p_size")
    bad = t.supplier.filter(col(p.column).like(p.pattern)).select("s_suppkey")  # keys are never null, so NOT IN is an anti-join
    rows = _offers(t, parts=parts).join(parts, col("ps_partkey") == col("p_partkey")).join(bad, col("ps_suppkey") == col("s_suppkey"), "left_anti")
    return (
        rows.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt"))
        .orderBy(col("supplier_cnt").desc(), "p_brand", "p_type", "p_size")
    )


def q17(t: Tables, p: Q) -> DataFrame:
    parts = t.part.filter((col("p_brand") == p.brand) & (col("p_container") == p.container)).select("p_partkey")
    lines = t.lineitem.join(parts, col("l_partkey") == col("p_partkey"), "left_semi").select("l_partkey", "l_quantity_c", "l_extendedprice_c")
    w = Window.partitionBy("l_partkey")
    # quantity < 0.2 * average, in whole numbers
    small = lines.withColumns({"sum": F.sum("l_quantity_c").over(w), "n": F.count("l_quantity_c").over(w)}).filter("l_quantity_c * n * 5 < sum")
    return small.agg((total(col("l_extendedprice_c"), 2) / 7.0).alias("avg_yearly"))


def q18(t: Tables, p: Q) -> DataFrame:
    large = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity_c").alias("quantity")).filter(col("quantity") > p.quantity * 100)
    rows = large.join(t.orders, col("l_orderkey") == col("o_orderkey")).join(t.customer, col("o_custkey") == col("c_custkey"))
    return rows.select(
        "c_name", "c_custkey", "o_orderkey", "o_orderdate", money(col("o_totalprice_c")).alias("o_totalprice"), money(col("quantity")).alias("sum(l_quantity)")
    ).orderBy(col("o_totalprice").desc(), "o_orderdate")


def q19(t: Tables, p: Q) -> DataFrame:
    of_line = col("l_shipmode").isin(*p.modes) & (col("l_shipinstruct") == "DELIVER IN PERSON")
    rows = t.lineitem.filter(of_line).join(t.part, col("l_partkey") == col("p_partkey"))
    wanted = F.lit(False)
    for brand, size, containers, low, most in p.bundles:
        wanted |= (
            (col("p_brand") == brand) & col("p_container").isin(*[f"{size} {c}" for c in containers])
            & col("l_quantity_c").between(low * 100, low * 100 + 1000) & col("p_size").between(1, most)
        )
    return rows.filter(wanted).agg(total(revenue_4(), 4).alias("revenue"))


def q20(t: Tables, p: Q) -> DataFrame:
    parts = t.part.filter(col("p_name").startswith(p.prefix)).select("p_partkey")
    lines = t.lineitem.filter(months_from("l_shipdate", p.day, 12)).join(parts, col("l_partkey") == col("p_partkey"), "left_semi")
    sold = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity_c").alias("sold"))
    surplus = _offers(t, parts=parts).join(sold, (col("ps_partkey") == col("l_partkey")) & (col("ps_suppkey") == col("l_suppkey"))).filter("ps_availqty * 200 > sold")
    return _suppliers(t, p.nation).join(surplus, col("s_suppkey") == col("ps_suppkey"), "left_semi").select("s_name", "s_address").orderBy("s_name")


def q21(t: Tables, p: Q) -> DataFrame:
    late = F.when(col("l_receiptdate") > col("l_commitdate"), col("l_suppkey"))
    per = t.lineitem.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("least"), F.max("l_suppkey").alias("most"),
        F.min(late).alias("late_least"), F.max(late).alias("late_most"), F.count(late).alias("late"),
    )
    alone = per.filter("least != most AND late_least = late_most")
    orders = t.orders.filter(col("o_orderstatus") == p.status).select("o_orderkey")
    rows = alone.join(orders, col("l_orderkey") == col("o_orderkey"), "left_semi").join(_suppliers(t, p.nation), col("late_least") == col("s_suppkey"))
    return rows.groupBy("s_name").agg(F.sum("late").alias("numwait")).orderBy(col("numwait").desc(), "s_name")


def q22(t: Tables, p: Q) -> DataFrame:
    code = F.substring("c_phone", 1, 2)
    people = t.customer.withColumn("cntrycode", code).filter(col("cntrycode").isin(*p.codes)).select("c_custkey", "cntrycode", "c_acctbal_c")
    mean = people.filter("c_acctbal_c > 0").agg((F.sum("c_acctbal_c") / F.count("c_acctbal_c")).alias("mean"))
    orders = t.orders.filter(since("o_orderdate", p.since)) if p.since else t.orders
    idle = people.join(mean, col("c_acctbal_c") > col("mean")).join(orders.select("o_custkey"), col("c_custkey") == col("o_custkey"), "left_anti")
    return idle.groupBy("cntrycode").agg(F.count(F.lit(1)).alias("numcust"), total(col("c_acctbal_c"), 2).alias("totacctbal")).orderBy("cntrycode")


_KINDS = ("CASE", "BOX", "PACK", "PKG"), ("BAG", "BOX", "PKG", "PACK"), ("CASE", "BOX", "PACK", "PKG")
#: The literals of each query.
BINDINGS: dict[str, Q] = {
    "q1": Q(day="1998-12-01", days=100),
    "q2": Q(size=8, type_end="ARD", region="ASIA"),
    "q3": Q(segment="BUILDING", day="1998-03-08"),
    "q4": Q(day="1996-09-01"),
    "q5": Q(region="AFRICA", day="1997-01-01"),
    "q6": Q(day="1996-01-01", discount=0.08, quantity=24),
    "q7": Q(one="NATION_6", other="NATION_7", first="1996-01-01", last="1997-12-31"),
    "q8": Q(nation="NATION_6", region="AMERICA", type="ECONOMY", first="1995-01-01", last="1996-12-31"),
    "q9": Q(name="ring"),
    "q10": Q(day="1996-08-01", flag="R"),
    "q11": Q(nation="NATION_7", one_in=10_000),
    "q12": Q(modes=("MAIL", "FOB"), day="1997-01-01"),
    "q13": Q(column="o_comment", pattern="%express%requests%"),
    "q14": Q(prefix="PROMO", day="1995-05-01"),
    "q15": Q(day="1996-02-01"),
    "q16": Q(brand="Brand#13", prefix="SMALL", sizes=(22, 18, 10, 14, 50, 7, 6, 25), column="s_comment", pattern="%Customer%Complaints%"),
    "q17": Q(brand="Brand#13", container="MED BOX"),
    "q18": Q(quantity=314),
    "q19": Q(modes=("AIR", "REG AIR"), bundles=(("Brand#14", "SM", _KINDS[0], 1, 25), ("Brand#15", "MED", _KINDS[1], 17, 30), ("Brand#25", "LG", _KINDS[2], 28, 35))),
    "q20": Q(prefix="small", nation="NATION_6", day="1997-01-01"),
    "q21": Q(status="F", nation="NATION_7"),
    "q22": Q(codes=("13", "17", "31", "23", "18", "29", "30"), since="2001-01-01"),
}
#: The literals of the published workload, for tables with its own names and comments; where absent, as above.
STANDARD: dict[str, Q] = BINDINGS | {
    "q2": Q(size=8, type_end="TIN", region="ASIA"),
    "q3": Q(segment="BUILDING", day="1995-03-08"),
    "q4": Q(day="1993-09-01"),
    "q6": Q(day="1993-01-01", discount=0.08, quantity=24),
    "q7": Q(one="ALGERIA", other="BRAZIL", first="1995-01-01", last="1996-12-31"),
    "q8": Q(nation="FRANCE", region="AMERICA", type="ECONOMY BRUSHED TIN", first="1995-01-01", last="1996-12-31"),
    "q9": Q(name="rosy"),
    "q10": Q(day="1993-08-01", flag="R"),
    "q11": Q(nation="RUSSIA", one_in=10_000),
    "q16": Q(brand="Brand#31", prefix="SMALL POLISHED", sizes=(22, 18, 10, 14, 50, 7, 6, 25), column="s_comment", pattern="%Customer%Complaints%"),
    "q19": Q(modes=("AIR", "AIR REG"), bundles=(("Brand#14", "SM", _KINDS[0], 1, 5), ("Brand#15", "MED", _KINDS[1], 17, 10), ("Brand#35", "LG", _KINDS[2], 28, 15))),
    "q20": Q(prefix="linen", nation="FRANCE", day="1997-01-01"),
    "q21": Q(status="F", nation="RUSSIA"),
    "q22": Q(codes=("13", "17", "31", "23", "18", "29", "30"), since=None),
}
PLANS: dict[str, Callable[[Tables, Q], DataFrame]] = {f.__name__: f for f in (q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22)}


def _query(name: str, bindings: dict[str, Q]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, path: str, **literals) -> DataFrame:
        return PLANS[name](load_tables(spark, path), Q(**(vars(bindings[name]) | literals)))

    query.__name__ = name
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name, BINDINGS) for name in PLANS}
STANDARD_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name, STANDARD) for name in PLANS}

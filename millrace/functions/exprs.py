"""Exact money arithmetic on long integers, and dates.

Amounts with two decimals are held as whole hundredths, so products are exact and stay
in generated code: price x (1 - discount) has four decimals, times (1 + tax) six. A sum of such
longs would overflow on tens of billions of rows, so each is kept as two sums, of
millions and of the rest, and put together once for each group as a decimal.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

_PART = 1_000_000


def hundredths(value: Column, kind: DataType) -> Column:
    """A two-decimal amount as long hundredths; of a decimal its digits, of a double the nearest."""
    if isinstance(kind, DecimalType):
        return (value * 100).cast("long")
    return F.rint(value * 100).cast("long")


def quotient(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def revenue_4(price: str = "l_extendedprice_c", discount: str = "l_discount_c") -> Column:
    return F.col(price) * (100 - F.col(discount))


def charge_6() -> Column:
    return revenue_4() * (100 + F.col("l_tax_c"))


def discount_value_4() -> Column:
    return F.col("l_extendedprice_c") * F.col("l_discount_c")


def profit_4() -> Column:
    return revenue_4() - F.col("ps_supplycost_c") * F.col("l_quantity_c")


def cost_4() -> Column:
    """Supply cost times available quantity; the quantity is a whole number."""
    return F.col("ps_supplycost_c") * F.col("ps_availqty") * 100


def total_exact(units: Column, scale: int) -> Column:
    """The sum of units of 10^-scale as an exact decimal(38, scale); null without rows.

    Hundredths are summed plainly: no table reaches 9 x 10^16 units of money. Fewer sums keep the
    generated code small enough to be compiled.
    """
    if scale <= 2:
        return (F.sum(units).cast("decimal(19,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(f"decimal(38,{scale})")
    whole = F.sum(quotient(units, _PART)).cast("decimal(24,0)") * F.lit(_PART).cast("decimal(7,0)") + F.sum(units % _PART).cast("decimal(20,0)")
    return (whole.cast("decimal(31,0)") * F.lit(f"0.{'0' * (scale - 1)}1").cast(f"decimal({scale},{scale})")).cast(f"decimal(38,{scale})")


def total(units: Column, scale: int) -> Column:
    """``total_exact`` as the nearest double."""
    return total_exact(units, scale).cast("double")


def exact_ratio(part: Column, whole: Column, scale: int) -> Column:
    return total(part, scale) / total(whole, scale)


def money(hundredths_: Column) -> Column:
    """Hundredths as a double."""
    return (hundredths_.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("double")


def year_of(day: Column) -> Column:
    return F.year(day).cast("long")


def moved(day: str, *, months: int = 0, days: int = 0) -> str:
    """A day moved by months (to the month's last day at most), then by days."""
    start = date.fromisoformat(day)
    k = start.year * 12 + start.month - 1 + months
    last = (date(k // 12 + k % 12 // 11, (k % 12 + 1) % 12 + 1, 1) - timedelta(1)).day
    return (date(k // 12, k % 12 + 1, min(start.day, last)) + timedelta(days)).isoformat()


def since(name: str, day: str) -> Column:
    """From ``day`` on. Compares the column as it is stored, so the scan can skip by it."""
    return F.col(f"{name}_at") >= F.lit(day)


def before(name: str, day: str) -> Column:
    """Before the start of ``day``, as stored."""
    return F.col(f"{name}_at") < F.lit(day)


def between_days(name: str, first: str, last: str) -> Column:
    """From ``first`` to ``last``, both included."""
    return since(name, first) & before(name, moved(last, days=1))


def months_from(name: str, day: str, months: int) -> Column:
    """A half-open range of months that starts on ``day``."""
    return since(name, day) & before(name, moved(day, months=months))

"""Column expressions. Money is summed exactly, so a sum doesn't depend on the order of the rows.

Sums run over whole numbers of a small unit: long arithmetic stays in generated code, where a decimal of each row would be an
object. Values beyond decimal(12,2) overflow a long and raise in ANSI mode.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def price(name: str = "l_extendedprice") -> Column:
    return F.col(name).cast("decimal(12,2)")


def rate(name: str) -> Column:
    return F.col(name).cast("decimal(4,2)")


def disc_price() -> Column:
    """price * (1 - discount)"""
    return price() * (F.lit(1) - rate("l_discount"))


def hundredths(name: str) -> Column:
    """A column of at most two decimals as a whole number of hundredths."""
    return F.floor(F.col(name).cast("double") * 100 + 0.5)


def disc_price_units() -> Column:
    """price * (1 - discount), in 1/10^4"""
    return hundredths("l_extendedprice") * (F.lit(100) - hundredths("l_discount"))


def charge_units() -> Column:
    """price * (1 - discount) * (1 + tax), in 1/10^6"""
    return disc_price_units() * (F.lit(100) + hundredths("l_tax"))


def revenue_units() -> Column:
    """price * discount, in 1/10^4"""
    return hundredths("l_extendedprice") * hundredths("l_discount")


def profit_units(cost: str = "ps_supplycost") -> Column:
    """price * (1 - discount) - supply cost * quantity, in 1/10^4"""
    return disc_price_units() - hundredths(cost) * hundredths("l_quantity")


def exact_sum(units: Column, places: int) -> Column:
    """The sum of whole numbers of 10^-places as a decimal; null over no rows.

    Both parts of each number are summed as long: they hold out for 10^12 rows and more.
    """
    high = F.sum(F.shiftright(units, 20)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND((1 << 20) - 1)).cast("decimal(20,0)")
    return (high * F.lit(Decimal(1 << 20)) + low).cast("decimal(30,0)") * F.lit(Decimal(1).scaleb(-places))


def cents(column: Column) -> Column:
    """A decimal rounded half up to two places."""
    return F.round(column, 2)


def as_double(column: Column) -> Column:
    return column.cast("double")


def contains(name: str, token: str) -> Column:
    """LIKE '%token%', as the predicate that Parquet readers can use."""
    return F.col(name).contains(token)


def ordered_tokens(name: str, first: str, second: str) -> Column:
    """LIKE '%first%second%'"""
    return F.col(name).like(f"%{first}%{second}%")


def year_of(name: str) -> Column:
    return F.year(F.col(name)).cast("int")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def days_before(text: str, days: int) -> Column:
    """A date less an interval; Catalyst folds it to a literal, so it reaches the scan."""
    return F.date_sub(day(text), days)

"""The five decision-support queries, each over a dict of tables, with their parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators.aggregation import histogram_of_counts
from tessera.operators.joins import outer_match_counts

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Q1:
    end: str = "1998-12-01"
    days: int = 90


@dataclass(frozen=True)
class Q3:
    segment: str = "BUILDING"
    day: str = "1995-03-15"
    top: int = 10


@dataclass(frozen=True)
class Q6:
    start: str = "1994-01-01"
    end: str = "1995-01-01"
    low: float = 0.05
    high: float = 0.07
    quantity: int = 24


@dataclass(frozen=True)
class Q9:
    token: str = "green"


@dataclass(frozen=True)
class Q13:
    first: str = "special"
    second: str = "requests"


def q1(t: Tables, p: Q1 = Q1()) -> DataFrame:
    """Pricing summary by return flag and line status, ordered by both."""
    rows = t["lineitem"].filter(F.col("l_shipdate") <= X.days_before(p.end, p.days))
    return (
        rows.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").cast("double").alias("sum_qty"),
            X.as_double(X.exact_sum(X.hundredths("l_extendedprice"), 2)).alias("sum_base_price"),
            X.as_double(X.exact_sum(X.disc_price_units(), 4)).alias("sum_disc_price"),
            X.as_double(X.exact_sum(X.charge_units(), 6)).alias("sum_charge"),
            F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("avg_qty"),
            F.round(F.avg(F.col("l_extendedprice").cast("double")), 6).alias("avg_price"),
            F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def q1_cent_rounded(t: Tables, p: Q1 = Q1()) -> DataFrame:
    """Discounted price and charge with every row rounded half up to cents before it is summed."""
    rows = t["lineitem"].filter(F.col("l_shipdate") <= X.days_before(p.end, p.days))
    net = X.cents(X.disc_price())
    gross = X.cents(net * (F.lit(1) + X.rate("l_tax")))
    return (
        rows.groupBy("l_returnflag", "l_linestatus")
        .agg(X.as_double(F.sum(net)).alias("sum_disc_price"), X.as_double(F.sum(gross)).alias("sum_charge"))
        .orderBy("l_returnflag", "l_linestatus")
    )


def q3_groups(t: Tables, p: Q3 = Q3()) -> DataFrame:
    """Revenue of every unshipped order of a segment; the customer side only filters."""
    orders = t["orders"]
    if "o_shippriority" not in orders.columns:
        orders = orders.withColumn("o_shippriority", F.lit(0).cast("int"))
    customers = t["customer"].filter(F.col("c_mktsegment") == p.segment).select(F.col("c_custkey").alias("o_custkey"))
    orders = (
        orders.filter(F.col("o_orderdate") < X.day(p.day))
        .join(customers, "o_custkey", "left_semi")
        .select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_shippriority")
    )
    lines = t["lineitem"].filter(F.col("l_shipdate") > X.day(p.day)).select("l_orderkey", "l_extendedprice", "l_discount")
    return (
        lines.join(orders, "l_orderkey")
        .groupBy("l_orderkey", "o_orderdate", "o_shippriority")
        .agg(X.as_double(F.round(X.exact_sum(X.disc_price_units(), 4), 2)).alias("revenue"))
        .select("l_orderkey", "revenue", "o_orderdate", "o_shippriority")
    )


def q3(t: Tables, p: Q3 = Q3()) -> DataFrame:
    """The orders of highest revenue; ties go by date, then key."""
    return q3_groups(t, p).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(p.top)


def q3_group_count(t: Tables, p: Q3 = Q3()) -> DataFrame:
    return q3_groups(t, p).agg(F.count("*").alias("n"))


def q6(t: Tables, p: Q6 = Q6()) -> DataFrame:
    """Revenue that a discount range cost in a period; null if no row qualifies."""
    rows = t["lineitem"].filter(
        (F.col("l_shipdate") >= X.day(p.start))
        & (F.col("l_shipdate") < X.day(p.end))
        & F.col("l_discount").between(p.low, p.high)
        & (F.col("l_quantity") < p.quantity)
    )
    return rows.agg(X.as_double(F.round(X.exact_sum(X.revenue_units(), 4), 2)).alias("revenue"))


def derived_cost() -> Column:
    """A supply cost that depends on part and supplier alone, where the dataset has no table of them."""
    return (F.lit(1) + (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 99900 / F.lit(100.0)).cast("decimal(15,2)")


def with_cost(t: Tables, lines: DataFrame) -> DataFrame:
    """The lines that have a supply cost, by part and supplier, with it."""
    if "partsupp" not in t:
        return lines.withColumn("ps_supplycost", derived_cost())
    costs = t["partsupp"].select(F.col("ps_partkey").alias("l_partkey"), F.col("ps_suppkey").alias("l_suppkey"), "ps_supplycost")
    return lines.join(costs, ["l_partkey", "l_suppkey"])


def q9_by_nation_year(t: Tables, p: Q9 = Q9()) -> DataFrame:
    """Decimal profit by nation and year; parts filter first, then the composite key, then orders."""
    parts = t["part"].filter(X.contains("p_name", p.token)).select(F.col("p_partkey").alias("l_partkey"))
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    lines = lines.join(parts, "l_partkey", "left_semi")
    places = (
        t["supplier"]
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("nation"))
    )
    years = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), X.year_of("o_orderdate").alias("o_year"))
    return (
        with_cost(t, lines)
        .join(places, "l_suppkey")
        .join(years, "l_orderkey")
        .groupBy("nation", "o_year")
        .agg(X.exact_sum(X.profit_units(), 4).alias("profit"))
    )


def q9(t: Tables, p: Q9 = Q9()) -> DataFrame:
    """Profit by nation (ascending) and year (descending)."""
    return (
        q9_by_nation_year(t, p)
        .select("nation", "o_year", X.as_double(F.round("profit", 2)).alias("sum_profit"))
        .orderBy("nation", F.desc("o_year"))
    )


def q9_yearly(t: Tables, p: Q9 = Q9()) -> DataFrame:
    """The same profit rolled up to years, from the exact sums."""
    return (
        q9_by_nation_year(t, p)
        .groupBy("o_year")
        .agg(X.as_double(F.round(F.sum("profit"), 2)).alias("sum_profit"))
        .orderBy("o_year")
    )


def q13_orders(t: Tables, p: Q13 = Q13()) -> DataFrame:
    """The orders that the outer join's ON clause lets through."""
    if "o_comment" in t["orders"].columns:
        return t["orders"].filter(~X.ordered_tokens("o_comment", p.first, p.second))
    return t["orders"].filter(~X.ordered_tokens("o_orderpriority", "NOT", "SPEC") & (F.col("o_orderstatus") == "F"))


def q13_order_counts(t: Tables, p: Q13 = Q13()) -> DataFrame:
    """Orders per customer, customers without any included."""
    return outer_match_counts(t["customer"].select("c_custkey"), "c_custkey", q13_orders(t, p), "o_custkey", "o_orderkey", "c_count")


def q13(t: Tables, p: Q13 = Q13()) -> DataFrame:
    """Customers by number of orders."""
    return histogram_of_counts(q13_order_counts(t, p), "c_count", "custdist").orderBy(F.desc("custdist"), F.desc("c_count"))

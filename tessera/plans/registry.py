"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import aggregation, joins, selection
from tessera.plans import tpch
from tessera.plans.sql import run_sql
from tessera.sources.tables import has_table, table

Query = Callable[[SparkSession, str], DataFrame]

Q6_DATA = tpch.Q6(start="1996-01-01", end="1997-01-01")
Q9_DATA = tpch.Q9(token="red")


class Dataset(dict):
    """The tables of a folder, opened when a plan first asks for them; ``in`` tells whether the folder has one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._folder = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table(self._spark, self._folder, name)
        return self[name]

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or has_table(self._spark, self._folder, str(name))


def _plan(build: Callable, *args) -> Query:
    return lambda spark, sf_dir: build(Dataset(spark, sf_dir), *args)


def _count_below(bound: int) -> Query:
    return _plan(lambda t: selection.select_below(t["lineitem"], "l_partkey", bound).agg(F.count("*").alias("n")))


_P, _D, _X = "CAST(l_extendedprice AS DECIMAL(12,2))", "CAST(l_discount AS DECIMAL(4,2))", "CAST(l_tax AS DECIMAL(4,2))"

_Q3 = f"""SELECT l_orderkey, CAST(ROUND(SUM({_P}*(1-{_D})),2) AS DOUBLE) AS revenue, o_orderdate, CAST(0 AS INTEGER) AS o_shippriority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
GROUP BY l_orderkey, o_orderdate"""

_Q9 = f"""SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS o_year,
  SUM({_P}*(1-{_D}) - ps_supplycost*CAST(l_quantity AS DECIMAL(12,2))) AS profit
FROM part, supplier, lineitem, (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
  CAST(1+((l_partkey*31+l_suppkey*17)%99900)/100.0 AS DECIMAL(15,2)) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey) ps, orders, nation
WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey
  AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%'
GROUP BY n_name, EXTRACT(YEAR FROM o_orderdate)"""

_Q13 = """SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders
  ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%NOT%SPEC%' AND o_orderstatus = 'F' GROUP BY c_custkey"""


def _q6_sql(start: str, end: str) -> str:
    return f"""SELECT CAST(ROUND(SUM({_P}*{_D}),2) AS DOUBLE) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '{start}' AND l_shipdate < DATE '{end}' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""


def _as_sql(text: str) -> tuple[Query, str]:
    """A query that is itself given as SQL."""
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text), text


REGISTRY: dict[str, tuple[Query, str]] = {
    **{
        f"selection_lt_{v}": (_count_below(v), f"SELECT COUNT(*) AS n FROM lineitem WHERE l_partkey < {v}")
        for v in (1000, 10000, 50000)
    },
    "selection_bitmap": (
        _plan(lambda t: selection.selection_flags(t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", 1000)),
        "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey < 1000 THEN 1 ELSE 0 END AS flag FROM lineitem",
    ),
    "selectivity": (
        _plan(lambda t: selection.selectivity(t["lineitem"], "l_partkey", (100, 500, 1000))),
        """SELECT CAST(v AS INTEGER) AS v, CAST(SUM(CASE WHEN l_partkey < v THEN 1 ELSE 0 END) AS BIGINT) AS matched,
ROUND(AVG(CASE WHEN l_partkey < v THEN 100.0e0 ELSE 0.0e0 END), 6) AS pct
FROM lineitem CROSS JOIN (SELECT 100 AS v UNION ALL SELECT 500 UNION ALL SELECT 1000) t GROUP BY v""",
    ),
    "aggregation_sum_quantity": (
        _plan(lambda t: aggregation.total(t["lineitem"], "l_quantity", "s")),
        "SELECT SUM(l_quantity) AS s FROM lineitem",
    ),
    "join_semi_count": (
        _plan(lambda t: joins.semi_count(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey")),
        "SELECT COUNT(*) AS n FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)",
    ),
    "join_inner_count": (
        _plan(lambda t: joins.inner_count(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey")),
        "SELECT COUNT(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    ),
    "q1": (
        _plan(tpch.q1),
        f"""SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, CAST(SUM({_P}) AS DOUBLE) AS sum_base_price,
CAST(SUM({_P}*(1-{_D})) AS DOUBLE) AS sum_disc_price, CAST(SUM({_P}*(1-{_D})*(1+{_X})) AS DOUBLE) AS sum_charge,
ROUND(AVG(l_quantity),6) AS avg_qty, ROUND(AVG(l_extendedprice),6) AS avg_price, ROUND(AVG(l_discount),6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    ),
    "q1_cent_rounded": (
        _plan(tpch.q1_cent_rounded),
        f"""SELECT l_returnflag, l_linestatus, CAST(SUM(dp) AS DOUBLE) AS sum_disc_price, CAST(SUM(ROUND(dp*(1+x),2)) AS DOUBLE) AS sum_charge
FROM (SELECT l_returnflag, l_linestatus, ROUND({_P}*(1-{_D}),2) AS dp, {_X} AS x FROM lineitem WHERE l_shipdate <= DATE '1998-09-02') t
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    ),
    "q3": (_plan(tpch.q3), f"{_Q3} ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"),
    "q3_group_count": (_plan(tpch.q3_group_count), f"SELECT COUNT(*) AS n FROM ({_Q3}) t"),
    "q6": (_plan(tpch.q6, Q6_DATA), _q6_sql(Q6_DATA.start, Q6_DATA.end)),
    "q6_reference_window": (_plan(tpch.q6), _q6_sql("1994-01-01", "1995-01-01")),
    "q9": (
        _plan(tpch.q9, Q9_DATA),
        f"SELECT nation, o_year, CAST(ROUND(profit, 2) AS DOUBLE) AS sum_profit FROM ({_Q9}) t ORDER BY nation, o_year DESC",
    ),
    "q9_yearly": (
        _plan(tpch.q9_yearly, Q9_DATA),
        f"SELECT o_year, CAST(ROUND(SUM(profit), 2) AS DOUBLE) AS sum_profit FROM ({_Q9}) t GROUP BY o_year ORDER BY o_year",
    ),
    "part_name_contains_count": (
        _plan(lambda t: t["part"].filter(X.contains("p_name", "red")).agg(F.count("*").alias("n"))),
        "SELECT COUNT(*) AS n FROM part WHERE p_name LIKE '%red%'",
    ),
    "q13": (_plan(tpch.q13), f"SELECT c_count, COUNT(*) AS custdist FROM ({_Q13}) c GROUP BY c_count ORDER BY custdist DESC, c_count DESC"),
    "q3_sql": _as_sql(f"{_Q3} ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"),
    "q6_sql": _as_sql(_q6_sql(Q6_DATA.start, Q6_DATA.end)),
    "q9_sql": _as_sql(f"SELECT nation, o_year, CAST(ROUND(profit, 2) AS DOUBLE) AS sum_profit FROM ({_Q9}) t ORDER BY nation, o_year DESC"),
    "q13_sql": _as_sql(f"SELECT c_count, COUNT(*) AS custdist FROM ({_Q13}) c GROUP BY c_count ORDER BY custdist DESC, c_count DESC"),
    "q13_order_counts": (_plan(tpch.q13_order_counts), _Q13),
    "max_keys": (
        _plan(
            lambda t: aggregation.max_keys(
                {
                    "c": (t["customer"], "c_custkey"),
                    "o": (t["orders"], "o_orderkey"),
                    "p": (t["part"], "p_partkey"),
                    "s": (t["supplier"], "s_suppkey"),
                }
            )
        ),
        """SELECT (SELECT MAX(c_custkey) FROM customer) AS c, (SELECT MAX(o_orderkey) FROM orders) AS o,
(SELECT MAX(p_partkey) FROM part) AS p, (SELECT MAX(s_suppkey) FROM supplier) AS s""",
    ),
}

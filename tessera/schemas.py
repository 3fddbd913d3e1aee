"""Schemas of the delimited star-schema tables; nullable as in the DDL."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)


def _schema(*columns: tuple[str, T.DataType], nullable: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name in nullable) for name, kind in columns])


_I, _S, _D = T.IntegerType(), T.StringType(), T.DateType()

TABLES: dict[str, T.StructType] = {
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I), ("n_comment", _S), nullable=("n_comment",)),
    "region": _schema(("r_regionkey", _I), ("r_name", _S), ("r_comment", _S), nullable=("r_comment",)),
    "part": _schema(
        ("p_partkey", _I), ("p_name", _S), ("p_mfgr", _S), ("p_brand", _S), ("p_type", _S),
        ("p_size", _I), ("p_container", _S), ("p_retailprice", MONEY), ("p_comment", _S),
    ),
    "supplier": _schema(
        ("s_suppkey", _I), ("s_name", _S), ("s_address", _S), ("s_nationkey", _I),
        ("s_phone", _S), ("s_acctbal", MONEY), ("s_comment", _S),
    ),
    "partsupp": _schema(("ps_partkey", _I), ("ps_suppkey", _I), ("ps_availqty", _I), ("ps_supplycost", MONEY), ("ps_comment", _S)),
    "customer": _schema(
        ("c_custkey", _I), ("c_name", _S), ("c_address", _S), ("c_nationkey", _I),
        ("c_phone", _S), ("c_acctbal", MONEY), ("c_mktsegment", _S), ("c_comment", _S),
    ),
    "orders": _schema(
        ("o_orderkey", _I), ("o_custkey", _I), ("o_orderstatus", _S), ("o_totalprice", MONEY), ("o_orderdate", _D),
        ("o_orderpriority", _S), ("o_clerk", _S), ("o_shippriority", _I), ("o_comment", _S),
    ),
    "lineitem": _schema(
        ("l_orderkey", _I), ("l_partkey", _I), ("l_suppkey", _I), ("l_linenumber", _I),
        ("l_quantity", MONEY), ("l_extendedprice", MONEY), ("l_discount", MONEY), ("l_tax", MONEY),
        ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _D), ("l_commitdate", _D), ("l_receiptdate", _D),
        ("l_shipinstruct", _S), ("l_shipmode", _S), ("l_comment", _S),
    ),
}

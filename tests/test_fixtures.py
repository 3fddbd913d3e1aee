"""Hand-computed fixtures over small delimited files, and the command line."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from tessera import cli, micro
from tessera.functions import exprs as X
from tessera.operators import joins, selection
from tessera.plans import tpch
from tessera.report import report
from tessera.schemas import TABLES
from tessera.plans.registry import REGISTRY
from tessera.results import compare, write_logs
from tessera.sources.tables import convert_to_parquet, load_checked, read_delimited, table, validate_dataset, verify_delimited
from tessera.streaming.grouped import running_pricing_summary, stream_table

FILL = {"int": "0", "string": "x", "date": "1995-01-01", "decimal(15,2)": "0.00"}


def write(tmp_path, name, rows):
    fields = TABLES[name].fields
    lines = ["|".join(str(r.get(f.name, FILL[f.dataType.simpleString()])) for f in fields) + "|" for r in rows]
    (tmp_path / f"{name}.tbl").write_text("\n".join(lines) + "\n")


def load(spark, tmp_path, **tables):
    for name, rows in tables.items():
        write(tmp_path, name, rows)
    return {name: read_delimited(spark, f"{tmp_path}/{name}.tbl", name) for name in tables}


def test_q13(spark, tmp_path):
    comments = [(1, 1, "quick special packages"), (2, 1, "special express requests"), (3, 1, "requests then special"), (4, 2, "specialrequests"), (5, 0, "short"), (6, 3, "Special requests")]
    t = load(spark, tmp_path, customer=[{"c_custkey": i} for i in range(4)], orders=[{"o_orderkey": k, "o_custkey": c, "o_comment": s} for k, c, s in comments])
    assert [tuple(r) for r in tpch.q13(t).collect()] == [(1, 2), (2, 1), (0, 1)]


def test_q9(spark, tmp_path):
    lines = [(1, 1, 7, 2, 100.00, 0.10), (2, 1, 7, 1, 50.00, 0.00), (1, 0, 0, 4, 30.00, 0.50), (1, 2, 7, 1, 10.00, 0.00), (2, 0, 7, 1, 10.00, 0.00)]
    t = load(
        spark,
        tmp_path,
        part=[{"p_partkey": k, "p_name": n} for k, n in ((1, "dark green lace"), (2, "red"), (0, "greenish"))],
        supplier=[{"s_suppkey": 0, "s_nationkey": 0}, {"s_suppkey": 7, "s_nationkey": 1}],
        nation=[{"n_nationkey": 0, "n_name": "ALGERIA"}, {"n_nationkey": 1, "n_name": "ARGENTINA"}],
        partsupp=[{"ps_partkey": p, "ps_suppkey": s, "ps_supplycost": c} for p, s, c in ((1, 7, "10.00"), (0, 0, "5.50"), (2, 7, "1.00"), (1, 0, "99.00"))],
        orders=[{"o_orderkey": 1, "o_orderdate": "1995-06-01"}, {"o_orderkey": 2, "o_orderdate": "1996-01-01"}],
        lineitem=[dict(zip(("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"), r, strict=True)) for r in lines],
    )
    assert [tuple(r) for r in tpch.q9(t).collect()] == [("ALGERIA", 1995, -7.0), ("ARGENTINA", 1996, 40.0), ("ARGENTINA", 1995, 70.0)]
    assert [tuple(r) for r in tpch.q9_yearly(t).collect()] == [(1995, 63.0), (1996, 40.0)]


def test_q9_takes_the_costs_of_a_folder_that_has_them(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("part", "supplier", "nation", "orders", "lineitem"):
        os.symlink(f"{source}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    without = {tuple(r)[:2]: r.sum_profit for r in REGISTRY["q9"][0](spark, str(tmp_path)).collect()}
    lines = spark.read.parquet(f"{source}/lineitem.parquet")
    lines.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"), F.lit(0).cast("decimal(15,2)").alias("ps_supplycost")).distinct().write.parquet(f"{tmp_path}/partsupp.parquet")
    free = {tuple(r)[:2]: r.sum_profit for r in REGISTRY["q9"][0](spark, str(tmp_path)).collect()}
    assert free.keys() == without.keys() and all(free[k] > without[k] for k in free)
    spark.read.parquet(f"{tmp_path}/partsupp.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none.parquet")
    os.rename(f"{tmp_path}/partsupp.parquet", f"{tmp_path}/old"), os.rename(f"{tmp_path}/none.parquet", f"{tmp_path}/partsupp.parquet")
    assert REGISTRY["q9_yearly"][0](spark, str(tmp_path)).count() == 0


def test_q3(spark, tmp_path):
    lines = [(10, "1995-03-16", 100, 0.10), (10, "1995-03-15", 999, 0), (10, "1995-04-01", 50, 0), (11, "1995-03-20", 70, 0), (0, "1995-03-20", 140, 0), (12, "1995-03-20", 80, 0)]
    t = load(
        spark,
        tmp_path,
        customer=[{"c_custkey": k, "c_mktsegment": s} for k, s in ((1, "BUILDING"), (2, "BANKING"), (0, "BUILDING"))],
        orders=[{"o_orderkey": k, "o_custkey": c, "o_orderdate": d} for k, c, d in ((10, 1, "1995-03-14"), (11, 2, "1995-03-14"), (0, 0, "1995-03-01"), (12, 1, "1995-03-15"))],
        lineitem=[{"l_orderkey": k, "l_shipdate": d, "l_extendedprice": p, "l_discount": x} for k, d, p, x in lines],
    )
    assert [tuple(r) for r in tpch.q3(t).collect()] == [(0, 140.0, dt.date(1995, 3, 1), 0), (10, 140.0, dt.date(1995, 3, 14), 0)]


def test_q1(spark, tmp_path):
    names = ("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    lines = [("A", "F", 1, 100000.01, 0.05, 0.02, "1998-09-02"), ("A", "F", 3, 10, 0, 0, "1998-09-03"), ("X", "F", 2, 10, 0.10, 0.05, "1995-01-01")]
    t = load(spark, tmp_path, lineitem=[dict(zip(names, r, strict=True)) for r in lines])
    got = [(r.l_returnflag, r.sum_qty, r.sum_base_price, r.sum_disc_price, r.sum_charge, r.count_order) for r in tpch.q1(t).collect()]
    assert got == [("A", 1.0, 100000.01, 95000.0095, 96900.00969, 1), ("X", 2.0, 10.0, 9.0, 9.45, 1)]
    assert [tuple(r) for r in tpch.q1_cent_rounded(t).collect()] == [("A", "F", 95000.01, 96900.01), ("X", "F", 9.0, 9.45)]


def test_q6(spark, tmp_path):
    lines = [("1994-01-01", 0.05, 23, 100), ("1994-12-31", 0.07, 23.99, 100), ("1995-01-01", 0.06, 1, 100), ("1994-06-01", 0.08, 1, 100), ("1994-06-01", 0.04, 1, 100), ("1994-06-01", 0.06, 24, 100)]
    t = load(spark, tmp_path, lineitem=[dict(zip(("l_shipdate", "l_discount", "l_quantity", "l_extendedprice"), r, strict=True)) for r in lines])
    assert tpch.q6(t).first().revenue == 12.0
    assert tpch.q6(t, tpch.Q6(start="1990-01-01", end="1991-01-01")).first().revenue is None


def test_joins_and_selection(spark):
    build, probe = spark.createDataFrame([(0,), (1,), (1,), (3,), (None,)], "b int"), spark.createDataFrame([(0,), (1,), (2,), (3,), (3,), (None,)], "p int")
    assert joins.semi_count(probe, "p", build, "b").first().n == 4
    assert joins.inner_count(probe, "p", build, "b").first().n == 5
    v = spark.createDataFrame([(-1,), (0,), (999,), (1000,), (1001,)], "v int")
    assert [r.flag for r in selection.selection_flags(v, "v", 1000).collect()] == [1, 1, 1, 0, 0]
    assert selection.selectivity(v, "v", (1000,)).first().pct == 60.0


def test_reader(spark, tmp_path):
    write(tmp_path, "region", [{"r_regionkey": 3, "r_name": "ASIA"}])
    assert tuple(read_delimited(spark, f"{tmp_path}/region.tbl", "region").first()) == (3, "ASIA", "x")
    with pytest.raises(Exception, match="(?i)path"):
        read_delimited(spark, f"{tmp_path}/missing.tbl", "region").count()
    (tmp_path / "bad.tbl").write_text("three|ASIA|x|\n")
    with pytest.raises(Exception):  # noqa: B017
        read_delimited(spark, f"{tmp_path}/bad.tbl", "region").collect()
    (tmp_path / "short.tbl").write_text("3|\n")
    with pytest.raises(Exception):  # noqa: B017
        read_delimited(spark, f"{tmp_path}/short.tbl", "region").collect()
    convert_to_parquet(spark, str(tmp_path), str(tmp_path / "out"), ("region",))
    assert validate_dataset(spark, str(tmp_path / "out"), ("region",), {"region": 1}) == {"region": 1}
    with pytest.raises(ValueError):
        validate_dataset(spark, str(tmp_path / "out"), ("region",), {"region": 2})


def test_load_with_check_and_reload(spark, tmp_path):
    write(tmp_path, "region", [{"r_regionkey": k} for k in range(3)])
    write(tmp_path, "nation", [{"n_nationkey": k} for k in range(2)])
    size = os.path.getsize(tmp_path / "region.tbl")
    assert verify_delimited(spark, str(tmp_path), ("region", "nation"))["region"] == (size, 3)
    with pytest.raises(ValueError, match="part"):
        verify_delimited(spark, str(tmp_path), ("region", "part"))
    out, want = f"{tmp_path}/out", {"region": 3, "nation": 2}
    assert load_checked(spark, str(tmp_path), out, want, tuple(want)) == want
    before = os.listdir(f"{out}/nation.parquet")
    table(spark, out, "region").limit(1).write.parquet(f"{tmp_path}/short")
    spark.read.parquet(f"{tmp_path}/short").write.mode("overwrite").parquet(f"{out}/region.parquet")
    assert load_checked(spark, str(tmp_path), out, want, tuple(want)) == want
    assert os.listdir(f"{out}/nation.parquet") == before  # what was right isn't loaded again
    with pytest.raises(ValueError):
        load_checked(spark, str(tmp_path), out, {"region": 4}, ("region",))


def test_result_logs(spark, tmp_path):
    ours, golden = f"{tmp_path}/ours", f"{tmp_path}/golden"
    for folder in (ours, golden):
        write_logs(spark, "/root/testdata/sf0.001", folder, ("q1", "q6", "q13"))
    assert compare(ours, golden) == []
    lines = (tmp_path / "ours/q13.csv").read_text().splitlines()
    assert lines[0] == "c_count,custdist" and len(lines) == 10
    (tmp_path / "ours/q13.csv").write_text("\n".join([lines[0], lines[2], lines[1], *lines[3:]]))
    (tmp_path / "ours/q6.csv").unlink()
    assert [x.split(":")[0] for x in compare(ours, golden)] == ["q13", "q6"]


def test_micro_metrics(spark):
    folder = "/root/testdata/sf0.001"
    found = {m["query"]: m for group in micro.MICRO.values() for m in group(spark, folder, 1)}
    assert found["selection_lt_1000"]["matches"] == 6000 and found["selection_lt_1000"]["selectivity_pct"] == 100
    assert found["aggregation_sum_quantity"]["sum"] == 152257.0 and found["aggregation_sum_quantity"]["gb_s"] > 0
    join = found["join_semi_count"]
    assert join["matches"] == 6000 and join["ms"] == pytest.approx(join["build_ms"] + join["probe_ms"])


def test_interval_cutoff(spark, tmp_path):
    t = load(spark, tmp_path, lineitem=[{"l_shipdate": d, "l_quantity": 1} for d in ("1998-09-02", "1998-09-03", "1998-10-02")])
    assert [tpch.q1(t, p).first().count_order for p in (tpch.Q1(), tpch.Q1(days=89), tpch.Q1(days=60))] == [1, 2, 3]


def test_entry_without_the_libraries_of_the_subpackage(tmp_path):
    (tmp_path / "regex.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; print(len(e.queries()), 'q3' in e.queries(), any(k.startswith('op') for k in e.queries()))"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", code], cwd=top, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert run.stdout.split()[-2:] == ["True", "False"]


def test_stream_agrees_with_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    batch = spark.read.parquet(path)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    running = running_pricing_summary(stream_table(spark, f"{tmp_path}/in", batch.schema, 1))
    run = running.writeStream.format("memory").queryName("pricing").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("pricing").collect())) == sorted(map(tuple, running_pricing_summary(batch).collect()))


def test_cli(capsys):
    assert cli.main(["help"]) == 0 and "usage" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 1


def test_sql_from_the_command_line(capsys):
    assert cli.main(["/root/testdata/sf0.001", "SELECT COUNT(*) AS n FROM lineitem, orders WHERE l_orderkey = o_orderkey"]) == 0
    assert "6000" in capsys.readouterr().out


def test_report(tmp_path):
    (tmp_path / "a.csv").write_text("20260101_000000,0.1,q1,2.0\n20260102_000000,0.1,q1,0.5\n20260101_000000,0.1,q3,1.0\n")
    (tmp_path / "b.csv").write_text("20260101_000000,0.1,q1,1.0\n")
    assert report(str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).splitlines()[2:] == ["| 0.1 | q1 | 0.5000 | 1.0000 | 2.00 |"]


def test_schema_is_read_again_after_a_change(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").columns == table(spark, str(tmp_path), "t").columns == ["id"]
    spark.range(3).selectExpr("id AS other").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").columns == ["other"]


def test_exact_sum(spark):
    rows = spark.createDataFrame([(-7,), (2**45 + 3,), (2**45 + 4,), (None,)], "x long")
    assert rows.agg(X.exact_sum(F.col("x"), 4).cast("string").alias("s")).first().s == "7036874417.7664"
    assert rows.filter("x IS NULL").agg(X.exact_sum(F.col("x"), 4).alias("s")).first().s is None

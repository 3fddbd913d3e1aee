"""Connected components by alternating large-star and small-star.

An edge list stays an edge list: no neighbourhood is ever gathered in one row or task. The minimum of a node's neighbours
comes from a map-side partial aggregate and is joined back by a shuffle that can split a hot node. Each round's edges go to
the shared checkpoint folder, so lineage doesn't grow and a lost executor costs no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, used_up


def _with_minimum(edges: DataFrame) -> DataFrame:
    """u, v and m, the least of u and all its v."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.pmod("u", F.lit(2)).alias("z"))
    # a second key, so that both sides are dealt out for the join and a hot u can be split
    return edges.withColumn("z", F.pmod("u", F.lit(2))).join(lowest, ["u", "z"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pointed = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return _with_minimum(down).select(pointed.alias("e")).select("e.u", "e.v").filter("u != v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """node and component, the least node that it reaches, for every node of ``links`` (u, v) but the components' own.

    Loops, repeated links and links with a null end are ignored; without links the result is empty.
    """
    edges = links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u IS NOT NULL AND v IS NOT NULL AND u != v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _fingerprint(edges)
    while before[0]:
        last, edges = edges, cut(_small_star(_large_star(edges)))
        used_up(last)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

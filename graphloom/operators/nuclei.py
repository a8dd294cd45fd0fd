"""Cliques, and nucleus numbers by repeated h-indices: cores, trusses and (3,4)-nuclei are one rule at sizes 1, 2 and 3.

The number of a clique of size r is the largest h of which it is in h cliques of size r + 1 whose other parts have
number h or more. Neighbours are distinct, without self-loops and directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.candidates import keep
from graphloom.operators.graph import Graph


def _oriented(g: Graph) -> DataFrame:
    """(lo, hi) of every neighbour pair, from the end of the smaller (degree, id): a hub has few edges that leave it."""
    adj = keep(g.adjacency(None, False).where("v <> nbr"), g.nodes.sparkSession)
    rank = adj.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    ends = adj.where("v < nbr").join(rank.withColumnRenamed("d", "dv"), "v").join(rank.select(F.col("v").alias("nbr"), F.col("d").alias("dn")), "nbr")
    first = F.struct("dv", "v") < F.struct("dn", "nbr")
    return keep(ends.select(F.when(first, F.col("v")).otherwise(F.col("nbr")).alias("lo"), F.when(first, F.col("nbr")).otherwise(F.col("v")).alias("hi")), g.nodes.sparkSession)


def cliques(g: Graph, size: int, oriented: DataFrame | None = None) -> DataFrame:
    """(s) of every clique of ``size`` nodes once: its ids in ascending order."""
    if size == 1:
        return g.nodes.select(F.array("v").alias("s"))
    e = _oriented(g) if oriented is None else oriented
    out = e.select(F.col("lo").alias("n0"), F.col("hi").alias("n1"))
    for k in range(2, size):
        out = out.join(e.select(F.col("lo").alias(f"n{k - 1}"), F.col("hi").alias(f"n{k}")), f"n{k - 1}")
        for i in range(k - 1):
            out = out.join(e.select(F.col("lo").alias(f"n{i}"), F.col("hi").alias(f"n{k}")), [f"n{i}", f"n{k}"], "left_semi")
    return out.select(F.array_sort(F.array(*[f"n{i}" for i in range(size)])).alias("s"))


def _without(i: int) -> Column:
    return F.filter("s", lambda x, at: at != i)


def nucleus_numbers(g: Graph, r: int) -> DataFrame:
    """(s, n) of every clique of r nodes.

    Estimates start at the number of larger cliques and only fall, so equal sums of two rounds are the end. Worths
    are counted by value before the window, so a hub's window holds its distinct values.
    """
    spark = g.nodes.sparkSession
    oriented = _oriented(g)
    parts = cliques(g, r + 1, oriented).select("s", F.explode(F.array(*map(_without, range(r + 1)))).alias("part"))
    parts = keep(parts.repartition("part"), spark, placed=True)
    now = keep(parts.groupBy("part").agg(F.count(F.lit(1)).alias("est")), spark, placed=True)
    total = None
    while True:
        state = now.agg(F.sum("est")).first()[0]
        if state == total:
            break
        total = state
        met = parts.join(now, "part").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("est", "part"))).alias("p"))  # r + 1 entries
        each = met.select(F.explode("p").alias("x"), F.col("p")[0].alias("least"), F.col("p")[1]["est"].alias("next"))
        worth = F.when(F.col("x.part") == F.col("least.part"), F.col("next")).otherwise(F.col("least.est"))
        counts = each.select(F.col("x.part").alias("part"), worth.alias("est")).groupBy("part", "est").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(W.partitionBy("part").orderBy(F.desc("est")))
        now = keep(counts.withColumn("h", F.least("est", above)).groupBy("part").agg(F.max("h").alias("est")), spark, placed=True)
    every = cliques(g, r, oriented)
    return every.join(now.withColumnRenamed("part", "s"), "s", "left").select("s", F.coalesce("est", F.lit(0)).cast("long").alias("n"))


def truss_numbers(g: Graph) -> DataFrame:
    """(a, b, truss) of every neighbour pair, a < b: in a k-truss each pair is in k - 2 triangles or more."""
    return nucleus_numbers(g, 2).select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), (F.col("n") + 2).alias("truss"))


def triangle_nuclei(g: Graph) -> DataFrame:
    """(a, b, c, n) of every triangle, a < b < c: its number among cliques of four."""
    return nucleus_numbers(g, 3).select(*[F.col("s")[i].alias(k) for i, k in enumerate("abc")], "n")


def k_truss(g: Graph, k: int) -> Graph:
    """The subgraph of the neighbour pairs whose truss number is k or more, with every edge between them."""
    pairs = keep(truss_numbers(g).where(F.col("truss") >= k).select("a", "b"), g.nodes.sparkSession)
    edges = g.edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(pairs, ["a", "b"], "left_semi").drop("a", "b")
    ends = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v")))
    return Graph(g.nodes.join(ends, "v", "left_semi"), edges)

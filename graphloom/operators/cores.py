"""Core numbers by repeated h-indices: a node's number is the largest h of which it has h neighbours of number h or more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.candidates import keep
from graphloom.operators.graph import Graph


def core_numbers(g: Graph) -> DataFrame:
    """(v, core) of every node, over distinct neighbours without self-loops.

    Estimates start at the degree and only fall, so equal sums of two rounds are the end. Adjacency is dealt by
    neighbour once; neighbours are counted by estimate before the window, so a hub's window holds its distinct estimates.
    """
    spark = g.nodes.sparkSession
    adj = keep(g.adjacency(None, False).where("v <> nbr").repartition("nbr"), spark, placed=True)
    now = keep(adj.groupBy("nbr").agg(F.count(F.lit(1)).alias("est")), spark, placed=True)  # both ends of every edge are there
    total = None
    while True:
        state = now.agg(F.sum("est")).first()[0]
        if state == total:
            break
        total = state
        counts = adj.join(now, "nbr").groupBy("v", "est").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(W.partitionBy("v").orderBy(F.desc("est")))
        now = keep(counts.withColumn("h", F.least("est", above)).groupBy(F.col("v").alias("nbr")).agg(F.max("h").alias("est")), spark, placed=True)
    return g.nodes.select("v").join(now.withColumnRenamed("nbr", "v"), "v", "left").select("v", F.coalesce("est", F.lit(0)).cast("long").alias("core"))


def k_core(g: Graph, k: int) -> Graph:
    """The subgraph of the nodes whose core number is k or more."""
    inside = keep(core_numbers(g).where(F.col("core") >= k).select("v"), g.nodes.sparkSession)
    edges = g.edges.join(inside.withColumnRenamed("v", "src"), "src", "left_semi").join(inside.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return Graph(g.nodes.join(inside, "v", "left_semi"), edges)

"""Path queries by breadth-first frontiers: one join a hop, visited nodes are left out by an anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.candidates import keep
from graphloom.operators.graph import Graph

#: Hops of an unbounded search.
UNBOUNDED = 999


def _steps(g: Graph, relations: list[str] | None, directed: bool) -> DataFrame:
    e = g.edges if relations is None else g.edges.where(F.col("rel").isin(relations))
    there = e.select(F.col("src").alias("v"), F.col("dst").alias("nbr"))
    return (there if directed else there.unionByName(e.select(F.col("dst").alias("v"), F.col("src").alias("nbr")))).distinct()


def reachable(g: Graph, sources: DataFrame, hops: int = -1, relations: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(origin, v, hops): nodes within the hops of each (origin) row, with the least number; a negative bound is none."""
    spark = g.nodes.sparkSession
    steps = _steps(g, relations, directed)
    seen = keep(sources.select("origin", F.col("origin").alias("v"), F.lit(0).alias("hops")), spark)
    front = seen
    for h in range(1, (UNBOUNDED if hops < 0 else hops) + 1):
        front = front.select("origin", "v").join(steps, "v").select("origin", F.col("nbr").alias("v")).distinct().join(seen.select("origin", "v"), ["origin", "v"], "left_anti")
        front = keep(front.withColumn("hops", F.lit(h)), spark)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_length(g: Graph, pairs: DataFrame, hops: int = -1, relations: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(a, b, length): the least number of edges from a to b, null where there is no path."""
    got = reachable(g, pairs.select(F.col("a").alias("origin")).distinct(), hops, relations, directed)
    return pairs.join(got.select(F.col("origin").alias("a"), F.col("v").alias("b"), F.col("hops").alias("length")), ["a", "b"], "left")


def shortest_path(g: Graph, a: int, b: int, hops: int = -1, relations: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(place, v): the nodes of one shortest path (of several, the smallest predecessors)."""
    spark = g.nodes.sparkSession
    got = keep(reachable(g, spark.createDataFrame([(a,)], "origin long"), hops, relations, directed), spark)
    end = got.where(F.col("v") == b).first()
    steps, out, now = _steps(g, relations, directed), [], b
    for h in range(end["hops"] if end else -1, -1, -1):
        out.append((h, now))
        if h:
            now = steps.where(F.col("nbr") == now).join(got.where(F.col("hops") == h - 1), "v").agg(F.min("v")).first()[0]
    return spark.createDataFrame(out, "place int, v long").orderBy("place")


def on_cycle(g: Graph, pairs: DataFrame, hops: int = -1, relations: list[str] | None = None, directed: bool = True) -> DataFrame:
    """(a, b, cycle): whether a closed walk goes through a and b."""
    there = shortest_length(g, pairs, hops, relations, directed).withColumnRenamed("length", "x")
    back = shortest_length(g, pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), hops, relations, directed).select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("length").alias("y"))
    return there.join(back, ["a", "b"]).select("a", "b", (F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") + F.col("y") > 0)).alias("cycle"))

"""A graph as DataFrames, and its adjacency views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """``nodes``: (v, emb, types array); ``edges``: (edge_id, src, rel, dst), a directed multigraph."""

    nodes: DataFrame
    edges: DataFrame

    def incident(self) -> DataFrame:
        """(v, way, rel, nbr) with multiplicity: a self-loop counts at both ends."""
        out = self.edges.select(F.col("src").alias("v"), F.lit("out").alias("way"), "rel", F.col("dst").alias("nbr"))
        return out.unionByName(self.edges.select(F.col("dst").alias("v"), F.lit("in").alias("way"), "rel", F.col("src").alias("nbr")))

    def adjacency(self, rel: str | None, directed: bool, forward: bool = True) -> DataFrame:
        """Distinct (v, nbr) pairs over a relation (None: any), from either end if undirected."""
        return self.steps(rel, directed, forward).distinct()

    def steps(self, rel: str | None, directed: bool, forward: bool = True) -> DataFrame:
        """The same pairs as often as there are edges: no shuffle, for semi-joins, minima and other uses that repeats don't change."""
        e = self.edges if rel is None else self.edges.where(F.col("rel") == rel)
        there = e.select(F.col("src").alias("v"), F.col("dst").alias("nbr"))
        back = e.select(F.col("dst").alias("v"), F.col("src").alias("nbr"))
        return there.unionByName(back) if not directed else there if forward else back

    def degrees(self) -> DataFrame:
        """(v, n_out, n_in, degree) over all edges."""
        way = lambda w: F.count(F.when(F.col("way") == w, 1))
        return self.incident().groupBy("v").agg(way("out").alias("n_out"), way("in").alias("n_in"), F.count(F.lit(1)).alias("degree"))

    def relation_degrees(self, directed: bool) -> DataFrame:
        """(v, way, rel, n): incident edges by direction (``any`` if undirected) and relation."""
        return self.incident().withColumn("way", F.col("way") if directed else F.lit("any")).groupBy("v", "way", "rel").agg(F.count(F.lit(1)).alias("n"))

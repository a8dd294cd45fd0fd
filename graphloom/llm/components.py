"""Connected components of an edge table: union-find in one task up to a bounded size, and beyond it alternating
large-star and small-star steps on settled tables (the labels are the same)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on (u, v) edges with u > v. Large: every larger neighbour is hooked to the smallest one; small: every
    smaller one is. The smallest neighbours are settled first, so that adaptive execution can split a hub's rows."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = common.settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "cc-least")
    hooked = both.join(least, "u")
    if large:
        out = hooked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
    return common.settle(out.where("u <> v").distinct(), "cc-edges")


#: Edges (16 bytes each) that one task takes.
ONE_TASK = 1 << 18


def _forest(batches):
    """(node, label) of all nodes, by union-find towards the smaller node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = p
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the (a, b) edges: label is the smallest node that links reach."""
    now = common.settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    if now.count() <= ONE_TASK:
        return common.settle(now.select("u", "v").coalesce(1).mapInArrow(_forest, "node long, label long"), "cc-labels")
    before = None
    while True:
        now = _star(_star(now, True), False)
        # a fixed point keeps the number of edges and the sum of the labels
        state = now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return common.settle(nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct()), "cc-labels")

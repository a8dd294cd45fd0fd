"""Bounds over a spanning tree: max-sum message passing, the safe leaf cap, and threshold pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.candidates import keep
from graphloom.operators.graph import Graph
from graphloom.operators.pattern import Pattern


def best_below(g: Graph, p: Pattern, cands: dict[int, DataFrame], root: int, directed: bool = False) -> dict[int, DataFrame]:
    """(v, b) of each pattern node: the least total distance of v and the best choices below it in the tree. Nodes that
    lack a neighbour for some child drop out. One shuffle for each tree edge, aggregated before it."""
    out = {u: c.select("v", F.col("s").alias("b")) for u, c in cands.items()}
    for parent, child, r, forward in reversed(p.tree(root)):
        below = out[child].select(F.col("v").alias("nbr"), F.col("b").alias("c"))
        best = g.steps(r, directed, forward).join(below, "nbr").groupBy("v").agg(F.min("c").alias("c"))
        out[parent] = out[parent].join(best, "v").select("v", (F.col("b") + F.col("c")).alias("b"))
    return out


def messages(cands: dict[int, DataFrame], tree: list[tuple[int, int, DataFrame]]) -> dict[int, DataFrame]:
    """(v, s, m..) of each pattern node: ``m{c}`` is the least total that child c and all below it add to v. ``tree`` has
    (parent, child, pairs (v of the parent, nbr of the child)), parents first. A node that has both a parent and children
    is read twice, so its rows (as many as candidates at most) are settled."""
    out = dict(cands)
    for parent, child, pairs in reversed(tree):
        sums = [c for c in out[child].columns if c.startswith("m")]
        if sums:
            out[child] = keep(out[child], out[child].sparkSession)
        below = out[child].select(F.col("v").alias("nbr"), reduce(lambda a, c: a + F.col(c), sums, F.col("s")).alias("b"))
        out[parent] = out[parent].join(pairs.join(below, "nbr").groupBy("v").agg(F.min("b").alias(f"m{child}")), "v")
    return out


def leaf_cap(g: Graph, parent: DataFrame, leaf: DataFrame, rel: str, cap: int, directed: bool = False, forward: bool = True) -> DataFrame:
    """The leaf candidates that are among the ``cap`` best of some parent candidate. Safe for exact top-k where cap is at
    least k + the number of pattern nodes - 1."""
    pairs = g.adjacency(rel, directed, forward).join(parent.select("v"), "v", "left_semi").join(leaf.select(F.col("v").alias("nbr"), "s"), "nbr")
    rank = F.row_number().over(W.partitionBy("v").orderBy("s", "nbr"))
    kept = pairs.withColumn("r", rank).where(F.col("r") <= cap).select(F.col("nbr").alias("v")).distinct()
    return leaf.join(kept, "v", "left_semi")


def sizes(cands: dict[int, DataFrame]) -> dict[int, tuple[int, float]]:
    """How many candidates each pattern node has, and their least distance, in one job; nodes without any are missing."""
    rows = union({u: c.select("s") for u, c in cands.items()}).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s")).collect()  # one per pattern node
    return {r["u"]: (r["n"], r["s"]) for r in rows}


def threshold_prune(cands: dict[int, DataFrame], tau: float) -> dict[int, DataFrame]:
    """Drops v of u where its distance plus the least distances of all other nodes exceeds tau, the score of k known
    matches; ties stay (a slack above the rounding that orders results)."""
    least = {u: s for u, (_, s) in sizes(cands).items()}
    if len(least) < len(cands):
        return cands
    total = sum(least.values())
    return {u: c.where(F.col("s") + F.lit(total - least[u]) <= F.lit(tau + 2e-6)) for u, c in cands.items()}


def union(parts: dict[int, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select(F.lit(u).alias("u"), *c.columns) for u, c in sorted(parts.items())])

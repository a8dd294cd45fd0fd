"""Classical candidate filters by name: passes of semi-joins and neighbourhood matching; only tightness differs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import bounds
from graphloom.operators import candidates as cd
from graphloom.operators.graph import Graph
from graphloom.operators.match import candidates_of, type_filter
from graphloom.operators.pattern import Pattern

#: Plans of this many unsettled steps are settled before more is built on them.
WEIGHT = 16


def simple_degrees(g: Graph) -> DataFrame:
    """(v, degree): distinct neighbours, direction and relation aside."""
    return g.adjacency(None, False).where("v <> nbr").groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def ldf(g: Graph, p: Pattern, u: int, mode: str = "none") -> DataFrame:
    """(v) of a compatible type and at least the pattern node's number of neighbours."""
    ok = g.nodes.where(type_filter(p.types.get(u), mode)).select("v")
    return ok.join(simple_degrees(g).where(F.col("degree") >= len(set(p.neighbours(u)))).select("v"), "v", "left_semi")


def nlf(g: Graph, p: Pattern, u: int, mode: str = "none") -> DataFrame:
    """LDF, and for each type of the pattern node's neighbours at least as many neighbours that have it. (Without types
    this is the degree alone.)"""
    out = ldf(g, p, u, mode)
    if mode == "none":
        return out
    need: dict[int, int] = {}
    for w in set(p.neighbours(u)):
        for t in p.types.get(w, ()) if mode == "composite" else ():
            need[t] = need.get(t, 0) + 1
    if not need:
        return out
    typed = g.adjacency(None, False).where("v <> nbr").join(g.nodes.select(F.col("v").alias("nbr"), F.explode("types").alias("t")), "nbr").groupBy("v", "t").agg(F.count(F.lit(1)).alias("n"))
    met = F.lit(False)
    for t, n in need.items():
        met = met | ((F.col("t") == t) & (F.col("n") >= n))
    return out.join(typed.where(met).groupBy("v").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == len(need)).select("v"), "v", "left_semi")


def levels(p: Pattern, root: int) -> list[list[int]]:
    """Breadth-first levels from root; parts that it does not reach follow, each from its lowest node."""
    out, seen = [], set()
    for start in [root, *range(p.nodes)]:
        level = [] if start in seen else [start]
        while level:
            seen.update(level)
            out.append(level)
            level = sorted({w for u in level for w in p.neighbours(u)} - seen)
    return out


def plan(name: str, p: Pattern, root: int) -> list[list[tuple[str, int, tuple[int, ...]]]]:
    """Passes of a named filter, each a list of steps. ``("semi", u, ws)`` keeps candidates of u with a neighbour among
    those of every w; ``("match", u, ws)`` those whose neighbours can be given to all ws at once, each to one."""
    level = levels(p, root)
    order = [u for x in level for u in x]
    rank = {u: i for i, u in enumerate(order)}
    depth = {u: i for i, x in enumerate(level) for u in x}
    near = {u: sorted(set(p.neighbours(u)), key=rank.__getitem__) for u in order}
    back = {u: tuple(w for w in near[u] if rank[w] < rank[u]) for u in order}
    ahead = {u: tuple(w for w in near[u] if rank[w] > rank[u]) for u in order}
    parent = {u: back[u][:1] for u in order}
    children = {u: tuple(w for w in ahead[u] if parent[w] == (u,)) for u in order}
    down, up = [("semi", u, back[u]) for u in order], [("semi", u, ahead[u]) for u in reversed(order)]
    match name:
        case "tso":
            out = [[("semi", u, parent[u]) for u in order], [("semi", u, children[u]) for u in reversed(order)]]
        case "cfl":
            same = {u: tuple(w for w in ahead[u] if depth[w] == depth[u]) for u in order}
            first = [step for x in level[1:] for step in [*(("semi", u, back[u]) for u in x), *(("semi", u, same[u]) for u in reversed(x))]]
            out = [first, [("semi", u, tuple(w for w in ahead[u] if depth[w] > depth[u])) for x in reversed(level[:-1]) for u in x]]
        case "ceci":
            cross = {u: tuple(w for w in back[u] if (w,) != parent[u]) for u in order}
            out = [[("semi", u, parent[u]) for u in order], [("semi", u, cross[u]) for u in order], up]
        case "dpiso":
            out = [down, up, down]
        case "veq":
            out = [[("semi", u, tuple(near[u])) for u in order], down, up, down]
        case "gql":
            out = [[("match", u, tuple(near[u])) for u in range(p.nodes)]] * 2
        case "calig":
            there = [("match", u, tuple(near[u])) for u in range(p.nodes)]
            out = [there, there[::-1], there]
        case _:
            raise ValueError(f"unknown filter: {name}")
    return [[step for step in steps if step[2]] for steps in out]


def between(g: Graph, p: Pattern, u: int, w: int) -> DataFrame:
    """(v, nbr), with repeats: different graph nodes joined by every relation that joins u and w."""
    rels = dict.fromkeys(r for a, r, b in p.proper if {a, b} == {u, w})
    return reduce(lambda x, y: x.join(y, ["v", "nbr"], "left_semi"), [g.steps(r, False) for r in rels]).where("v <> nbr")


def matchable(g: Graph, p: Pattern, u: int, ws: tuple[int, ...], cands: dict[int, DataFrame]) -> DataFrame:
    """(v) whose neighbours can be given to the nodes ws, a different candidate to each.

    By Hall's theorem: every set of the ws must have as many neighbours, in the union of its candidates, as it has nodes.
    A neighbour counts by the mask of the ws it is a candidate of, so a graph node has at most 2^|ws| rows after the sum.
    """
    bits = [between(g, p, u, w).join(cands[w].select(F.col("v").alias("nbr")), "nbr", "left_semi").select("v", "nbr", F.lit(1 << i).alias("bit")) for i, w in enumerate(ws)]
    masks = reduce(DataFrame.unionByName, bits).groupBy("v", "nbr").agg(F.bit_or("bit").alias("mask")).groupBy("v", "mask").agg(F.count(F.lit(1)).alias("n"))
    each = masks.groupBy("v").agg(F.collect_list(F.struct("mask", "n")).alias("have"))
    enough = lambda s: F.aggregate("have", F.lit(0).cast("long"), lambda n, x: n + F.when(x["mask"].bitwiseAND(s) != 0, x["n"]).otherwise(0)) >= F.bit_count(s)
    return each.where(F.forall(F.sequence(F.lit(1), F.lit((1 << len(ws)) - 1)), enough)).select("v")


def run(name: str, g: Graph, p: Pattern, mode: str = "none", root: int | None = None, cands: dict[int, DataFrame] | None = None) -> dict[int, DataFrame]:
    """Candidates (v, s) of every node under a named filter.

    ``ldf`` and ``nlf`` look at degrees; ``rm`` reduces the edge relations to the fixpoint; ``tso``, ``cfl``, ``ceci``,
    ``dpiso`` and ``veq`` pass support along the breadth-first order from ``root`` (the node with the fewest candidates
    for its degree); ``gql`` and ``calig`` check that neighbours can be matched, in two and three passes. Edge relations
    count in every step. Each pass is settled. ``cands``: what to start from (all nodes of the type otherwise).
    """
    first = ldf if name in ("ldf", "dpiso", "veq") else nlf
    base = cands or candidates_of(g, p, mode)
    now = {u: base[u].join(first(g, p, u, mode), "v", "left_semi") for u in range(p.nodes)}
    if name in ("ldf", "nlf"):
        return now
    if name == "rm":
        return cd.refine(g, p, now)
    if root is None:
        n = bounds.sizes(now)
        root = min(range(p.nodes), key=lambda u: (n.get(u, (0, 0.0))[0] / max(p.degree(u), 1), u))
    now = settled(g, p, now)
    for steps in plan(name, p, root):
        weight = dict.fromkeys(now, 1)
        for kind, u, ws in steps:
            if kind == "match":
                now[u] = now[u].join(matchable(g, p, u, ws, now), "v", "left_semi")
            else:
                for w in ws:
                    now[u] = now[u].join(between(g, p, u, w).join(now[w].select(F.col("v").alias("nbr")), "nbr", "left_semi").select("v"), "v", "left_semi")
            weight[u] += sum(weight[w] for w in ws)
            if weight[u] > WEIGHT:  # plans nest: dense patterns are settled within the pass
                now[u], weight[u] = cd.keep(now[u], g.nodes.sparkSession), 1
        now = settled(g, p, now)
    return now


def settled(g: Graph, p: Pattern, cands: dict[int, DataFrame]) -> dict[int, DataFrame]:
    rows = cd.keep(cd.flat(cands), g.nodes.sparkSession)
    return {u: rows.where(F.col("u") == u).select("v", "s") for u in range(p.nodes)}


def candidate_edges(g: Graph, p: Pattern, cands: dict[int, DataFrame], directed: bool = False) -> DataFrame:
    """(eid, v, w): graph pairs of each pattern edge whose ends are both candidates."""
    parts = []
    for i, (a, r, b) in enumerate(p.edges):
        pairs = g.adjacency(r, directed, True)
        near = pairs.join(cands[a].select("v"), "v", "left_semi").join(cands[b].select(F.col("v").alias("nbr")), "nbr", "left_semi")
        parts.append(near.select(F.lit(i).alias("eid"), "v", F.col("nbr").alias("w")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def composite_labels(g: Graph) -> DataFrame:
    """(v, label): each distinct type set gets a number, by the order of the sets."""
    sets = g.nodes.select(F.array_sort(F.array_distinct("types")).alias("t")).distinct()
    from pyspark.sql import Window as W

    numbered = sets.withColumn("label", F.dense_rank().over(W.orderBy("t")).cast("int"))  # as many rows as type sets
    return g.nodes.select("v", F.array_sort(F.array_distinct("types")).alias("t")).join(numbered, "t").select("v", "label")

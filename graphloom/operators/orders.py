"""Join orders by name, planned on the driver from counts of candidates and candidate edges.

An order only changes how many partial matches there are, never the matches. All orders put a node after a neighbour of
it where its part of the pattern has one placed already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import bounds, filters
from graphloom.operators.graph import Graph
from graphloom.operators.pattern import Pattern


@dataclass(frozen=True)
class Statistics:
    """``nodes``: candidates of each pattern node; ``edges``: graph pairs between the candidates of each pattern edge's
    ends, by (smaller node, larger node), the least where edges are parallel."""

    nodes: dict[int, int]
    edges: dict[tuple[int, int], int]

    def edge(self, u: int, w: int) -> int:
        return self.edges.get((min(u, w), max(u, w)), 0)

    def fanout(self, u: int, w: int) -> float:
        """Mean number of w's candidates next to one of u's."""
        return self.edge(u, w) / max(self.nodes.get(u, 0), 1)


def statistics(g: Graph, p: Pattern, cands: dict[int, DataFrame], directed: bool = False) -> Statistics:
    """Both counts in two jobs, one row per pattern node and edge to the driver."""
    found = {r["eid"]: r["n"] for r in filters.candidate_edges(g, p, cands, directed).groupBy("eid").agg(F.count(F.lit(1)).alias("n")).collect()} if p.edges else {}
    edges: dict[tuple[int, int], int] = {}
    for i, (a, _, b) in enumerate(p.edges):
        key = (min(a, b), max(a, b))
        edges[key] = min(edges.get(key, found.get(i, 0)), found.get(i, 0))
    return Statistics({u: n for u, (n, _) in bounds.sizes(cands).items()}, edges)


def _grow(p: Pattern, start: Callable[[int], tuple], step: Callable[[int, list[int]], tuple]) -> list[int]:
    """The least node by ``start`` first, then of the adjacent nodes the least by ``step``; each further part likewise."""
    out: list[int] = []
    while len(out) < p.nodes:
        left = [u for u in range(p.nodes) if u not in out]
        near = [u for u in left if any(w in out for w in p.neighbours(u))]
        out.append(min(near, key=lambda u: (*step(u, out), u)) if near else min(left, key=lambda u: (*start(u), u)))
    return out


def _degree(p: Pattern, u: int) -> int:
    return len(set(p.neighbours(u)))


def _placed(p: Pattern, u: int, out: list[int]) -> list[int]:
    return [w for w in set(p.neighbours(u)) if w in out]


def gql(p: Pattern, s: Statistics) -> list[int]:
    """Fewest candidates first, then the adjacent node with fewest; ties to the larger degree."""
    key = lambda u, out=(): (s.nodes.get(u, 0), -_degree(p, u))
    return _grow(p, key, key)


def qsi(p: Pattern, s: Statistics) -> list[int]:
    """The cheapest candidate edge first, then the cheapest that leaves the placed nodes; ties to fewer placed neighbours,
    then to the larger degree."""
    start = lambda u: (min((s.edge(u, w) for w in p.neighbours(u)), default=0), -_degree(p, u))
    return _grow(p, start, lambda u, out: (min(s.edge(u, w) for w in _placed(p, u, out)), len(_placed(p, u, out)), -_degree(p, u)))


def ri(p: Pattern, s: Statistics) -> list[int]:
    """Structure alone: largest degree first, then most placed neighbours, most unplaced neighbours that touch the placed
    ones, most others."""

    def step(u: int, out: list[int]) -> tuple:
        free = [w for w in set(p.neighbours(u)) if w not in out]
        return (-len(_placed(p, u, out)), -sum(bool(_placed(p, w, out)) for w in free), -sum(not _placed(p, w, out) for w in free))

    return _grow(p, lambda u: (-_degree(p, u),), step)


def vf2pp(p: Pattern, s: Statistics) -> list[int]:
    """Level by level from the rarest node (then the largest degree): most placed neighbours, larger degree, rarer."""
    root = min(range(p.nodes), key=lambda u: (s.nodes.get(u, 0), -_degree(p, u), u))
    out: list[int] = []
    for level in filters.levels(p, root):
        left = list(level)
        while left:
            u = min(left, key=lambda u: (-len(_placed(p, u, out)), -_degree(p, u), s.nodes.get(u, 0), u))
            left.remove(u)
            out.append(u)
    return out


def ceci(p: Pattern, s: Statistics) -> list[int]:
    """Breadth first from the node with the fewest candidates for its degree."""
    return [u for level in filters.levels(p, _root(p, s)) for u in level]


def tso(p: Pattern, s: Statistics) -> list[int]:
    """Paths from root to leaf of the breadth-first tree, the one with the least estimated matches first."""
    return _by_paths(p, s, _root(p, s), lambda u: 0)


def cfl(p: Pattern, s: Statistics) -> list[int]:
    """Core first (what stays when nodes of degree one are peeled off), then tree parts, then leaves; within each by the
    estimated matches of paths."""
    core = set(range(p.nodes))
    while True:
        thin = {u for u in core if len(set(p.neighbours(u)) & core) < 2}
        if not thin:
            break
        core -= thin
    rank = lambda u: 0 if u in core else 2 if _degree(p, u) == 1 else 1
    root = min(core or range(p.nodes), key=lambda u: (s.nodes.get(u, 0) / max(_degree(p, u), 1), u))
    return _by_paths(p, s, root, rank)


def dpiso(p: Pattern, s: Statistics) -> list[int]:
    """The adjacent node with the least weight: its candidates times the estimated matches of the best tree path below."""
    parent, order = _tree(p, _root(p, s))
    below = dict.fromkeys(range(p.nodes), 1.0)
    for u in reversed(order):
        kids = [w for w in order if parent.get(w) == u]
        if kids:
            below[u] = min(max(s.fanout(u, w), 1e-9) * below[w] for w in kids)
    key = lambda u, out=(): (s.nodes.get(u, 0) * below[u],)
    return _grow(p, lambda u: (u != order[0], *key(u)), key)


def _root(p: Pattern, s: Statistics) -> int:
    return min(range(p.nodes), key=lambda u: (s.nodes.get(u, 0) / max(_degree(p, u), 1), u))


def _tree(p: Pattern, root: int) -> tuple[dict[int, int], list[int]]:
    order = [u for level in filters.levels(p, root) for u in level]
    parent = {}
    for i, u in enumerate(order):
        back = [w for w in order[:i] if w in p.neighbours(u)]
        if back:
            parent[u] = back[0]
    return parent, order


def _by_paths(p: Pattern, s: Statistics, root: int, rank: Callable[[int], int]) -> list[int]:
    parent, order = _tree(p, root)
    cost = {}
    for u in order:  # matches of the tree path that ends here
        cost[u] = cost[parent[u]] * max(s.fanout(parent[u], u), 1e-9) if u in parent else float(s.nodes.get(u, 0))
    leaves = [u for u in order if u not in parent.values()]
    out: list[int] = []
    for wanted in sorted({rank(u) for u in order}):
        for leaf in sorted(leaves, key=lambda u: (cost[u], u)):
            path = [leaf]
            while path[-1] in parent:
                path.append(parent[path[-1]])
            out += [u for u in reversed(path) if u not in out and rank(u) == wanted]
    return out if valid(p, out) else _grow(p, lambda u: (u != root, cost[u]), lambda u, o: (rank(u), cost[u]))


ORDERS: dict[str, Callable[[Pattern, Statistics], list[int]]] = {"gql": gql, "qsi": qsi, "ri": ri, "vf2pp": vf2pp, "ceci": ceci, "tso": tso, "cfl": cfl, "dpiso": dpiso}


def order(name: str, p: Pattern, s: Statistics) -> list[int]:
    out = ORDERS[name](p, s)
    if not valid(p, out):
        raise ValueError(f"{name} gave no valid order: {out}")
    return out


def valid(p: Pattern, out: list[int]) -> bool:
    """Every node once, and each next to one before it unless no node left is."""
    if sorted(out) != list(range(p.nodes)):
        return False
    return all(_placed(p, u, out[:i]) or not any(_placed(p, w, out[:i]) for w in out[i:]) for i, u in enumerate(out))


def spectrum(p: Pattern, most: int) -> list[list[int]]:
    """Up to ``most`` valid orders, in lexical order."""

    def grow(out: list[int]) -> Iterator[list[int]]:
        if len(out) == p.nodes:
            yield out
            return
        left = [u for u in range(p.nodes) if u not in out]
        for u in [u for u in left if _placed(p, u, out)] or left:
            yield from grow([*out, u])

    return [x for x, _ in zip(grow([]), range(most))]

"""Query patterns: a few nodes and edges, planned on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    """``edges``: (source, relation, target) over node numbers; ``vectors``: node -> query vector (none: any node)."""

    nodes: int
    edges: tuple[tuple[int, str, int], ...]
    vectors: dict[int, list[float]] = field(default_factory=dict, hash=False)
    types: dict[int, tuple[int, ...]] = field(default_factory=dict, hash=False)

    @property
    def proper(self) -> list[tuple[int, str, int]]:
        """Edges between different nodes; duplicates stay (they raise degree requirements)."""
        return [e for e in self.edges if e[0] != e[2]]

    def neighbours(self, u: int) -> list[int]:
        return [b if a == u else a for a, _, b in self.proper if u in (a, b)]

    def degree(self, u: int) -> int:
        return len(self.neighbours(u))

    def cover(self) -> list[int]:
        """A vertex cover: again and again the node with the most uncovered edges, the lowest on ties; {0} if none."""
        left, out = list(self.proper), set()
        while left:
            load = {u: sum(u in (a, b) for a, _, b in left) for u in range(self.nodes)}
            u = max(sorted(load), key=load.__getitem__)
            out.add(u)
            left = [e for e in left if u not in (e[0], e[2])]
        return sorted(out) or [0]

    def order(self, sizes: dict[int, int] | None = None) -> list[int]:
        """A join order: the smallest candidate set first (ties: larger degree, lower number), then adjacent ones."""
        key = lambda u: ((sizes or {}).get(u, 0), -self.degree(u), u)
        out: list[int] = []
        while len(out) < self.nodes:
            near = [u for u in range(self.nodes) if u not in out and any(w in out for w in self.neighbours(u))]
            # of adjacent nodes the one with most edges back, which closes cycles early
            out.append(min(near, key=lambda u: (-sum(w in out for w in self.neighbours(u)), *key(u))) if near else min((u for u in range(self.nodes) if u not in out), key=key))
        return out

    def tree(self, root: int) -> list[tuple[int, int, str, bool]]:
        """A spanning tree as (parent, child, relation, forward) in depth-first order."""
        seen, out = {root}, []

        def visit(u: int) -> None:
            for forward in (True, False):
                for a, r, b in self.proper:
                    parent, child = (a, b) if forward else (b, a)
                    if parent == u and child not in seen:
                        seen.add(child)
                        out.append((u, child, r, forward))
                        visit(child)

        visit(root)
        return out

    def requirements(self, u: int, directed: bool) -> dict[tuple[str, str], int]:
        """How many incident edges of each (direction, relation) a match of node u needs."""
        out: dict[tuple[str, str], int] = {}
        for a, r, b in self.proper:
            if u in (a, b):
                way = ("out" if a == u else "in") if directed else "any"
                out[way, r] = out.get((way, r), 0) + 1
        return out


def merged(names: list[str], edges: list[tuple[int, str, int]], vectors: dict[int, list[float]]) -> Pattern:
    """A pattern whose equally named nodes are one; edges keep their order, ones out of range are dropped."""
    first: dict[str, int] = {}
    number = [first.setdefault(name, len(first)) for name in names]
    kept = [(number[a], r, number[b]) for a, r, b in edges if 0 <= a < len(names) and 0 <= b < len(names)]
    at: dict[int, list[float]] = {}
    for u, v in vectors.items():
        at.setdefault(number[u], v)
    return Pattern(len(first), tuple(kept), at)

"""Pattern matching as join chains.

The driver orders the pattern's nodes; each next node is one join of the partial matches with an adjacency, every
further edge to matched nodes is a semi-join, and all-different is a predicate of each join. Exact top-k prunes with a
threshold: the k-th best score among matches of the best few candidates bounds all partial scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import bounds
from graphloom.operators.candidates import distances
from graphloom.operators.graph import Graph
from graphloom.operators.pattern import Pattern

#: Candidates of each node that the threshold's first job looks at, and how many times more each next one does.
SEED, STEP = 64, 4


def type_filter(types_q: tuple[int, ...] | None, mode: str):
    """Node compatibility: ``none``, ``intersection`` (a common type) or ``composite`` (the same type set)."""
    if mode == "none" or types_q is None:
        return F.lit(True)
    q = F.array(*[F.lit(t) for t in sorted(types_q)])
    return F.arrays_overlap("types", q) if mode == "intersection" else F.array_sort("types") == q


def chain(g: Graph, p: Pattern, cands: dict[int, DataFrame], directed: bool, injective: bool, tau: float | None = None, label_sets: bool = False, order: list[int] | None = None) -> DataFrame:
    """All matches: (v0.., score). ``label_sets``: of parallel pattern edges any relation suffices. ``order``: of the joins."""
    known = bounds.sizes(cands) if tau is not None else {}
    order = order or p.order({u: known[u][0] if u in known else 0 for u in cands} if tau is not None else None)
    first = order[0]
    groups: dict[tuple[int, int], list[tuple[int, str, int]]] = {}
    for e in dict.fromkeys(p.edges):
        key = (min(e[0], e[2]), max(e[0], e[2])) if label_sets else e
        groups.setdefault(key, []).append(e)

    def pairs(es: list[tuple[int, str, int]], u: int) -> DataFrame:
        """Distinct (v, nbr) from the matched end to u over any of the parallel edges."""
        parts = [g.adjacency(r, directed, b == u) for a, r, b in es]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.distinct() if len(parts) > 1 else out

    def loops(df: DataFrame, u: int) -> DataFrame:
        """Self-loop edges of u, checked before the cut to k."""
        for r in dict.fromkeys(r for a, r, b in p.edges if a == b == u):
            own = g.edges.where((F.col("rel") == r) & (F.col("src") == F.col("dst"))).select(F.col("src").alias(f"v{u}")).distinct()
            df = df.join(own, f"v{u}", "left_semi")
        return df

    other = lambda e, u: e[0] if e[2] == u else e[2]
    steps, done = [], [first]
    for u in order[1:]:
        steps.append((u, [es for es in groups.values() if es[0][0] != es[0][2] and u in (es[0][0], es[0][2]) and other(es[0], u) in done]))
        done.append(u)
    tree = [(other(mine[0][0], u), u, pairs(mine[0], u)) for u, mine in steps if mine]
    own = {u: c.select("v", "s") for u, c in cands.items()}
    if tau is not None:
        own = bounds.messages(own, tree)
    rest, whole = {u: n[1] for u, n in known.items()}, {first: {first}}
    for u, mine in steps:  # which nodes' messages arrive at the first of their connected part
        at = next((r for r, part in whole.items() if mine and other(mine[0][0], u) in part), u)
        whole.setdefault(at, set()).add(u)

    def cut(df: DataFrame, done: list[int]) -> DataFrame:
        """Drops partial matches whose score, with the least that each tree branch and each part not begun adds, exceeds tau."""
        if tau is None:
            return df
        least = F.col("score") + F.lit(float(sum(rest.get(x, 0.0) for r, part in whole.items() if r not in done for x in part)))
        return df.where(reduce(lambda x, c: x + F.col(c), [c for c in df.columns if c.startswith("m")], least) <= F.lit(tau + 2e-6))

    as_node = lambda u, name: own[u].withColumnsRenamed({"v": f"v{u}", "s": name})
    got, done = cut(loops(as_node(first, "score"), first), [first]), [first]
    for u, mine in steps:
        if mine:
            w = other(mine[0][0], u)
            got = got.drop(f"m{u}").join(pairs(mine[0], u).select(F.col("v").alias(f"v{w}"), F.col("nbr").alias(f"v{u}")), f"v{w}").join(as_node(u, "s"), f"v{u}")
        else:  # a part of the pattern of its own: bounded candidates on one side, all partial matches on the other
            got = got.join(as_node(u, "s"))
        got = got.withColumn("score", F.col("score") + F.col("s")).drop("s")
        if injective:
            for w in done:
                got = got.where(F.col(f"v{w}") != F.col(f"v{u}"))
        done.append(u)
        got = cut(got, done)
        for es in mine[1:]:
            w = other(es[0], u)
            got = got.join(pairs(es, u).select(F.col("v").alias(f"v{w}"), F.col("nbr").alias(f"v{u}")), [f"v{w}", f"v{u}"], "left_semi")
        got = loops(got, u)
    return got.select(*[f"v{u}" for u in range(p.nodes)], "score")


def candidates_of(g: Graph, p: Pattern, mode: str = "none") -> dict[int, DataFrame]:
    """All type-compatible nodes of each pattern node with their distances."""
    full = distances(g, {u: p.vectors.get(u) for u in range(p.nodes)})
    out = {}
    for u in range(p.nodes):
        c = full.where(F.col("u") == u).select("v", "s")
        if mode != "none" and u in p.types:
            c = c.join(g.nodes.where(type_filter(p.types[u], mode)).select("v"), "v", "left_semi")
        out[u] = c
    return out


def distinct_edges(p: Pattern):
    """No graph edge is used twice: (smaller end, relation, larger end) of all pattern edges differ."""
    each = [F.concat_ws("|", F.least(f"v{a}", f"v{b}").cast("string"), F.lit(r), F.greatest(f"v{a}", f"v{b}").cast("string")) for a, r, b in dict.fromkeys(p.edges)]
    return F.size(F.array_distinct(F.array(*each))) == len(each)


def top_k(g: Graph, p: Pattern, k: int = 3, directed: bool = False, injective: bool = True, mode: str = "none", label_sets: bool = False, edge_distinct: bool = False, cands: dict[int, DataFrame] | None = None, prune: bool = True, order: list[int] | None = None) -> DataFrame:
    """(v0.., score): the k matches of least total distance, ordered by (score to 6 digits, ids)."""
    cands = cands or candidates_of(g, p, mode)
    names = [f"v{u}" for u in range(p.nodes)]

    def ranked(c: dict[int, DataFrame], tau: float | None) -> DataFrame:
        rows = chain(g, p, c, directed, injective, tau, label_sets, order)
        if edge_distinct:
            rows = rows.where(distinct_edges(p))
        return rows.withColumn("score", F.round("score", 6)).orderBy("score", *names).limit(k)

    tau, most, seed = None, max((n for n, _ in bounds.sizes(cands).values()), default=0) if prune and p.vectors else 0, SEED
    # a wider look bounds tighter; it goes on until there are k matches, and is as wide as STEP times SEED at least
    while seed < most and (tau is None or seed <= STEP * SEED):
        few = {u: c.orderBy("s", "v").limit(seed) for u, c in (cands if tau is None else bounds.threshold_prune(cands, tau)).items()}
        found = ranked(few, tau).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("worst")).first()
        tau = found["worst"] if found["n"] == k else tau
        seed *= STEP
    if tau is not None:
        cands = bounds.threshold_prune(cands, tau)
    return ranked(cands, tau)


def count_matches(g: Graph, p: Pattern, directed: bool = False, injective: bool = True) -> DataFrame:
    """(n): the number of matches."""
    return chain(g, Pattern(p.nodes, p.edges), candidates_of(g, Pattern(p.nodes, p.edges)), directed, injective).agg(F.count(F.lit(1)).alias("n"))


def with_edges(g: Graph, p: Pattern, matches: DataFrame, directed: bool = False) -> DataFrame:
    """(rank, eid, src, rel, dst, score): the graph edge of each pattern edge in the graph's own direction, the forward one
    where both exist."""
    from pyspark.sql import Window as W

    ranked = matches.withColumn("rank", F.row_number().over(W.orderBy("score", *[f"v{u}" for u in range(p.nodes)])).cast("int"))  # k rows
    each = F.array(*[F.struct(F.lit(i).alias("eid"), F.col(f"v{a}").alias("a"), F.lit(r).alias("rel"), F.col(f"v{b}").alias("b")) for i, (a, r, b) in enumerate(p.edges)])
    rows = ranked.select("rank", "score", F.inline(each))
    e = g.edges.select(F.col("src").alias("s"), F.col("rel").alias("r"), F.col("dst").alias("d")).distinct()
    there = rows.join(e, (F.col("a") == F.col("s")) & (F.col("rel") == F.col("r")) & (F.col("b") == F.col("d")), "left").withColumnRenamed("s", "fs").drop("r", "d")
    back = e.select(F.col("s").alias("s2"), F.col("r").alias("r2"), F.col("d").alias("d2"))
    both = there.join(back, (F.col("b") == F.col("s2")) & (F.col("rel") == F.col("r2")) & (F.col("a") == F.col("d2")), "left") if not directed else there.withColumn("s2", F.lit(None))
    forward = F.col("fs").isNotNull()
    return both.where(forward | F.col("s2").isNotNull()).select("rank", "eid", F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), "rel", F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), "score")

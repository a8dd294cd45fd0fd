"""Matching queries over the vector graph, each with a plain SQL statement of the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.operators import bounds, candidates, filters, match, orders
from graphloom.operators.pattern import Pattern
from graphloom.sources import fixture

URGENT, HIGH, MEDIUM, NONE, LOW = "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"
#: pattern edges and the embeddings that serve as query vectors (a node without one matches any node at no cost)
PATTERNS: dict[str, tuple[int, tuple[tuple[int, str, int], ...], dict[int, int]]] = {
    "edge": (2, ((0, URGENT, 1),), {0: 3, 1: 17}),
    "path2": (3, ((0, URGENT, 1), (1, HIGH, 2)), {0: 3, 1: 17, 2: 42}),
    "path3": (4, ((0, URGENT, 1), (1, HIGH, 2), (2, LOW, 3)), {0: 3, 1: 17, 2: 42, 3: 8}),
    "star3": (4, ((0, URGENT, 1), (0, URGENT, 2), (0, HIGH, 3)), {0: 3, 1: 17, 2: 42, 3: 8}),
    "triangle": (3, ((0, LOW, 1), (1, LOW, 2), (2, LOW, 0)), {0: 3, 1: 17, 2: 42}),
    "cycle4": (4, ((0, URGENT, 1), (1, HIGH, 2), (2, URGENT, 3), (3, HIGH, 0)), {0: 3, 1: 17, 2: 42, 3: 8}),
    "tree5": (5, ((0, URGENT, 1), (0, HIGH, 2), (1, LOW, 3), (1, MEDIUM, 4)), {0: 3, 1: 17, 2: 42, 3: 8, 4: 99}),
    "wildcard": (3, ((0, MEDIUM, 1), (1, NONE, 2)), {0: 3, 2: 42}),
    "parallel": (3, ((0, URGENT, 1), (0, LOW, 1), (1, HIGH, 2)), {0: 3, 1: 17, 2: 42}),
}
K = 10
TYPES = {0: (2, 10), 1: (3, 5, 11), 2: (1, 12)}
#: Whole type sets, for the composite mode.
TYPE_SETS = {0: (2, 10), 1: (3, 11)}

GRAPH = """n AS (SELECT count(*) AS N FROM embeddings),
e AS (SELECT DISTINCT CAST(o_custkey % N AS BIGINT) AS src, o_orderpriority AS rel, CAST((o_orderkey * 7 + 3) % N AS BIGINT) AS dst FROM orders, n),
a AS (SELECT src AS v, rel, dst AS w FROM e UNION SELECT dst, rel, src FROM e),
ty AS (SELECT vec_id AS v, [label, CAST(10 + vec_id % 3 AS INTEGER)] AS types FROM embeddings)"""


def _distance(ids: dict[int, int]) -> str:
    values = ", ".join(f"({u}, {i})" for u, i in ids.items())
    return (
        f"q AS (SELECT * FROM (VALUES {values}) t(u, qid)),\ns AS (SELECT q.u, k.vec_id AS v, list_distance(CAST(k.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) AS d "
        "FROM q JOIN embeddings x ON x.vec_id = q.qid CROSS JOIN embeddings k)"
    )


def match_sql(name: str, directed: bool = False, injective: bool = True, mode: str = "none", label_sets: bool = False, edge_distinct: bool = False, count: bool = False) -> str:
    n, edges, ids = PATTERNS[name]
    source = "(SELECT src AS v, rel, dst AS w FROM e)" if directed else "a"
    at: dict[int, str] = {}
    tables, where = [], []
    if label_sets:
        groups: dict[tuple[int, int], list[str]] = {}
        for x, r, y in edges:
            groups.setdefault((x, y), []).append(r)
        parts = [(x, y, f"(SELECT DISTINCT v, w FROM {source} WHERE rel IN ({', '.join(repr(r) for r in rs)}))") for (x, y), rs in groups.items()]
    else:
        parts = [(x, y, f"(SELECT DISTINCT v, w FROM {source} WHERE rel = '{r}')") for x, r, y in edges]
    for i, (x, y, t) in enumerate(parts):
        tables.append(f"{t} e{i}")
        for u, c in ((x, f"e{i}.v"), (y, f"e{i}.w")):
            if u in at:
                where.append(f"{at[u]} = {c}")
            else:
                at[u] = c
    for u in ids:
        tables.append(f"s s{u}")
        where += [f"s{u}.u = {u}", f"s{u}.v = {at[u]}"]
    if mode != "none":
        for u, ts in (TYPE_SETS if mode == "composite" else TYPES).items():
            if u < n:
                tables.append(f"ty t{u}")
                want = "[" + ", ".join(str(x) for x in sorted(ts)) + "]"
                where += [f"t{u}.v = {at[u]}", f"list_has_any(t{u}.types, {want})" if mode == "intersection" else f"list_sort(t{u}.types) = {want}"]
    if injective:
        where += [f"{at[x]} <> {at[y]}" for x in range(n) for y in range(x)]
    if edge_distinct:
        each = [f"concat_ws('|', least({at[x]}, {at[y]}), '{r}', greatest({at[x]}, {at[y]}))" for x, r, y in edges]
        where.append(f"len(list_distinct([{', '.join(each)}])) = {len(each)}")
    body = f"FROM {', '.join(tables)} WHERE {' AND '.join(where)}"
    if count:
        return f"WITH {GRAPH},\n{_distance(ids)}\nSELECT count(*) AS n {body}"
    names = ", ".join(f"v{u}" for u in range(n))
    return f"WITH {GRAPH},\n{_distance(ids)}\nSELECT {', '.join(f'{at[u]} AS v{u}' for u in range(n))}, round({' + '.join(f's{u}.d' for u in ids)}, 6) AS score {body} ORDER BY score, {names} LIMIT {K}"


def pattern(spark: SparkSession, sf_dir: str, name: str, mode: str = "none") -> Pattern:
    n, edges, ids = PATTERNS[name]
    return Pattern(n, edges, fixture.vectors_of(spark, sf_dir, ids), {u: t for u, t in (TYPE_SETS if mode == "composite" else TYPES).items() if u < n} if mode != "none" else {})


def _match(name: str, **how) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: match.top_k(fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, name, how.get("mode", "none")), K, **how)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


for _name in PATTERNS:
    _add("match_path2_topk" if _name == "path2" else f"match_{_name}", _match(_name), match_sql(_name))
for _name in ("edge", "path2", "star3", "tree5"):
    _add(f"match_directed_{_name}", _match(_name, directed=True), match_sql(_name, directed=True))
for _name in ("path2", "triangle", "star3", "cycle4"):
    _add(f"homomorphic_{_name}", _match(_name, injective=False, edge_distinct=True), match_sql(_name, injective=False, edge_distinct=True))
    _add(f"match_count_{_name}", lambda spark, sf_dir, x=_name: match.count_matches(fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, x)), match_sql(_name, count=True))
_add("labelset_parallel", _match("parallel", label_sets=True), match_sql("parallel", label_sets=True))
_add("type_intersection_path2", _match("path2", mode="intersection"), match_sql("path2", mode="intersection"))
_add("type_composite_edge", _match("edge", mode="composite"), match_sql("edge", mode="composite"))
_add("match_unpruned_path2", _match("path2", prune=False), match_sql("path2"))


def match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, "path2")
    return match.with_edges(g, p, match.top_k(g, p, K))


_inner = match_sql("path2").replace("WITH ", "", 1)
_head, _, _tail = _inner.rpartition("\nSELECT")
_add(
    "match_edges", match_edges,
    f"""WITH {_head}, m AS (SELECT *, CAST(row_number() OVER (ORDER BY score, v0, v1, v2) AS INTEGER) AS rank FROM (SELECT{_tail})),
x AS (SELECT rank, score, 0 AS eid, v0 AS a, '{URGENT}' AS rel, v1 AS b FROM m UNION ALL SELECT rank, score, 1, v1, '{HIGH}', v2 FROM m)
SELECT rank, eid, CASE WHEN f.src IS NOT NULL THEN a ELSE b END AS src, x.rel, CASE WHEN f.src IS NOT NULL THEN b ELSE a END AS dst, score
FROM x LEFT JOIN e f ON f.src = x.a AND f.rel = x.rel AND f.dst = x.b""",
)


def _vec(name: str, f, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = fixture.vectors_of(spark, sf_dir, {0: 3})[0]
        return fixture.read(spark, sf_dir, "embeddings").select("vec_id", F.round(f(F.col("embedding"), q), 6).alias("x"))

    _add(name, query, f"SELECT k.vec_id, round({sql}, 6) AS x FROM embeddings k, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)")


_vec("vec_l2", vector.l2, "list_distance(CAST(k.embedding AS DOUBLE[]), q)")
_vec("vec_sql2", vector.squared_l2, "pow(list_distance(CAST(k.embedding AS DOUBLE[]), q), 2)")
_vec("vec_dot", vector.dot, "list_dot_product(CAST(k.embedding AS DOUBLE[]), q)")


def _graph(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, "path2"))


_S = f"WITH {GRAPH},\n{_distance(PATTERNS['path2'][2])}"
_BUDGET = 50
_KNN = f"knn AS (SELECT * FROM (SELECT u, v, d, row_number() OVER (PARTITION BY u ORDER BY d, v) AS r FROM s) WHERE r <= {_BUDGET})"
_DEG = "inc AS (SELECT src AS v, 'out' AS way, rel, dst AS nbr FROM e UNION ALL SELECT dst, 'in', rel, src FROM e), deg AS (SELECT v, count(*) FILTER (way = 'out') AS n_out, count(*) FILTER (way = 'in') AS n_in, count(*) AS degree FROM inc GROUP BY v)"
_add("knn_topn", _graph(lambda g, p: candidates.nearest(g, p.vectors, _BUDGET).select("u", "v", F.round("s", 6).alias("s"))), f"{_S}, {_KNN} SELECT u, v, round(d, 6) AS s FROM knn")
_add("degree_stats", _graph(lambda g, p: g.degrees()), f"WITH {GRAPH}, {_DEG} SELECT * FROM deg")
_add("degree_summary", _graph(lambda g, p: g.degrees().agg(F.max("n_out").alias("max_out"), F.max("n_in").alias("max_in"), F.max("degree").alias("max_degree"), F.count(F.lit(1)).alias("touched"))), f"WITH {GRAPH}, {_DEG} SELECT max(n_out) AS max_out, max(n_in) AS max_in, max(degree) AS max_degree, count(*) AS touched FROM deg")
_add("rel_degree", _graph(lambda g, p: g.relation_degrees(False)), f"WITH {GRAPH}, {_DEG} SELECT v, 'any' AS way, rel, count(*) AS n FROM inc GROUP BY v, rel")
_add("rel_degree_filter", _graph(lambda g, p: candidates.relation_degree_ok(g, p, 1, False)), f"WITH {GRAPH}, {_DEG} SELECT v FROM inc GROUP BY v HAVING count(*) FILTER (rel = '{URGENT}') >= 1 AND count(*) FILTER (rel = '{HIGH}') >= 1")
_COVER = f"{_KNN}, {_DEG}, c1 AS (SELECT knn.v, d AS s FROM knn WHERE u = 1 AND v IN (SELECT v FROM deg WHERE degree >= 2) AND v IN (SELECT v FROM inc WHERE rel = '{URGENT}') AND v IN (SELECT v FROM inc WHERE rel = '{HIGH}'))"
_add("cover_candidates", _graph(lambda g, p: candidates.flat(candidates.cover_candidates(g, p, _BUDGET)).select("u", "v", F.round("s", 6).alias("s"))), f"{_S}, {_COVER} SELECT 1 AS u, v, round(s, 6) AS s FROM c1")
# on a path the middle node is the cover; its candidates, and then their neighbours, are one pass of support
_REFINED = f"""{_COVER}, c0 AS (SELECT v, d AS s FROM s WHERE u = 0 AND v IN (SELECT v FROM a WHERE rel = '{URGENT}' AND w IN (SELECT v FROM c1))),
c2 AS (SELECT v, d AS s FROM s WHERE u = 2 AND v IN (SELECT v FROM a WHERE rel = '{HIGH}' AND w IN (SELECT v FROM c1))),
f AS (SELECT 0 AS u, v, s FROM c0 UNION ALL SELECT 1, v, s FROM c1 UNION ALL SELECT 2, v, s FROM c2)"""


def _refined(g, p):
    return candidates.refine(g, p, candidates.cover_candidates(g, p, _BUDGET))


_add("refine_fixpoint", _graph(lambda g, p: candidates.flat(_refined(g, p)).select("u", "v", F.round("s", 6).alias("s"))), f"{_S}, {_REFINED} SELECT u, v, round(s, 6) AS s FROM f")
_add(
    "candidate_summary", _graph(lambda g, p: candidates.summary(candidates.flat(_refined(g, p)), p)),
    f"{_S}, {_REFINED}, c AS (SELECT u, count(*) AS n FROM f GROUP BY u) SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, CAST(sum(n) FILTER (u = 1) AS BIGINT) AS cover, CAST(sum(n) FILTER (u <> 1) AS BIGINT) AS independent FROM c",
)
_BELOW = f"""b2 AS (SELECT v, s FROM c2), b1 AS (SELECT c1.v, c1.s + m.x AS s FROM c1 JOIN (SELECT a.v, min(b2.s) AS x FROM a JOIN b2 ON a.w = b2.v WHERE a.rel = '{HIGH}' GROUP BY a.v) m ON m.v = c1.v),
b0 AS (SELECT c0.v, c0.s + m.x AS s FROM c0 JOIN (SELECT a.v, min(b1.s) AS x FROM a JOIN b1 ON a.w = b1.v WHERE a.rel = '{URGENT}' GROUP BY a.v) m ON m.v = c0.v)"""
_add(
    "upper_bounds", _graph(lambda g, p: bounds.union(bounds.best_below(g, p, _refined(g, p), 0)).select("u", "v", F.round("b", 6).alias("b"))),
    f"{_S}, {_REFINED}, {_BELOW} SELECT 0 AS u, v, round(s, 6) AS b FROM b0 UNION ALL SELECT 1, v, round(s, 6) FROM b1 UNION ALL SELECT 2, v, round(s, 6) FROM b2",
)
_add(
    "leaf_cap", _graph(lambda g, p: (lambda c: bounds.leaf_cap(g, c[1], c[2], HIGH, 3 + p.nodes - 1))(_refined(g, p)).select("v", F.round("s", 6).alias("s"))),
    f"{_S}, {_REFINED}, k AS (SELECT a.v, a.w, c2.s, row_number() OVER (PARTITION BY a.v ORDER BY c2.s, a.w) AS r FROM a JOIN c1 ON a.v = c1.v JOIN c2 ON a.w = c2.v WHERE a.rel = '{HIGH}') SELECT v, round(s, 6) AS s FROM c2 WHERE v IN (SELECT w FROM k WHERE r <= 5)",
)


def lb_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, "path2")
    found = match.top_k(g, p, K).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("worst")).first()
    all_ = match.candidates_of(g, p)
    return bounds.union(bounds.threshold_prune(all_, found["worst"]) if found["n"] == K else all_).select("u", "v")


_add(
    "lb_prune", lb_prune,
    f"WITH {_head}, m AS (SELECT{_tail}), t AS (SELECT max(score) AS tau, count(*) AS n FROM m), l AS (SELECT u, min(d) AS x FROM s GROUP BY u), z AS (SELECT sum(x) AS total FROM l) SELECT s.u, s.v FROM s JOIN l ON l.u = s.u, t, z WHERE t.n < {K} OR s.d + (z.total - l.x) <= t.tau + 2e-6",
)

_SIMPLE = "sd AS (SELECT v, count(DISTINCT w) AS degree FROM a WHERE v <> w GROUP BY v)"
_add("filter_ldf", _graph(lambda g, p: filters.ldf(g, p, 1)), f"WITH {GRAPH}, {_SIMPLE} SELECT v FROM sd WHERE degree >= 2")


def _typed(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, "path2", "intersection"))


_add("filter_ldf_intersection", _typed(lambda g, p: filters.ldf(g, p, 1, "intersection")), f"WITH {GRAPH}, {_SIMPLE} SELECT v FROM sd JOIN ty USING (v) WHERE degree >= 2 AND list_has_any(types, [3, 5, 11])")
_NEAR = f"""r AS (SELECT 0 AS u, 1 AS w, '{URGENT}' AS rel UNION ALL SELECT 1, 2, '{HIGH}')"""
# every node starts as its degree says; on a path the fixpoint is reached by passing support from both ends to the middle and back
_CFL = f"""{_SIMPLE}, l AS (SELECT v FROM sd WHERE degree >= 1), m0 AS (SELECT v FROM sd WHERE degree >= 2),
m AS (SELECT v FROM m0 WHERE v IN (SELECT v FROM a WHERE rel = '{URGENT}' AND w IN (SELECT v FROM l)) AND v IN (SELECT v FROM a WHERE rel = '{HIGH}' AND w IN (SELECT v FROM l))),
x0 AS (SELECT v FROM l WHERE v IN (SELECT v FROM a WHERE rel = '{URGENT}' AND w IN (SELECT v FROM m))), x2 AS (SELECT v FROM l WHERE v IN (SELECT v FROM a WHERE rel = '{HIGH}' AND w IN (SELECT v FROM m)))"""
_add("filter_rm", _graph(lambda g, p: candidates.flat(filters.run("rm", g, p)).select("u", "v")), f"WITH {GRAPH}, {_CFL} SELECT 0 AS u, v FROM x0 UNION ALL SELECT 1, v FROM m UNION ALL SELECT 2, v FROM x2")


def filter_sql(name: str, pattern_name: str, root: int) -> str:
    """Candidates after each step of a filter's plan, as one chain of CTEs; matching by choosing different neighbours."""
    n, edges, ids = PATTERNS[pattern_name]
    p = Pattern(n, edges)
    at, parts = {}, [GRAPH, _distance(ids), _KNN, "sd AS (SELECT v, count(DISTINCT w) AS degree FROM a WHERE v <> w GROUP BY v)"]
    for u in range(n):
        at[u] = f"c{u}"
        parts.append(f"c{u} AS (SELECT v FROM sd JOIN knn USING (v) WHERE knn.u = {u} AND degree >= {len(set(p.neighbours(u)))})")
    for i, (kind, u, ws) in enumerate(step for steps in filters.plan(name, p, root) for step in steps):
        pairs = [" INTERSECT ".join(f"SELECT v, w FROM a WHERE rel = '{r}'" for x, r, y in edges if {x, y} == {u, w}) for w in ws]
        if kind == "semi":
            keep = " AND ".join(f"v IN (SELECT v FROM ({x}) WHERE v <> w AND w IN (SELECT v FROM {at[w]}))" for w, x in zip(ws, pairs))
        else:
            joined = ", ".join(f"(SELECT v, w FROM ({x}) WHERE v <> w AND w IN (SELECT v FROM {at[w]})) y{j}" for j, (w, x) in enumerate(zip(ws, pairs)))
            differ = [f"y{j}.v = y0.v" for j in range(1, len(ws))] + [f"y{j}.w <> y{k}.w" for j in range(len(ws)) for k in range(j)]
            keep = f"v IN (SELECT y0.v FROM {joined} WHERE {' AND '.join(differ) or 'true'})"
        parts.append(f"z{i} AS MATERIALIZED (SELECT v FROM {at[u]} WHERE {keep})")
        at[u] = f"z{i}"
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {u} AS u, v FROM {at[u]}" for u in range(n))


def _filtered(name: str, on: str) -> Callable[[SparkSession, str], DataFrame]:
    """The filter over the nearest nodes of each pattern node, which leaves it something to do in a dense graph."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, p = fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, on)
        near = candidates.nearest(g, p.vectors, _BUDGET)
        return candidates.flat(filters.run(name, g, p, root=0, cands={u: near.where(F.col("u") == u).select("v", "s") for u in range(p.nodes)})).select("u", "v")

    return query


for _filter, _on in (("gql", "star3"), ("calig", "tree5"), ("tso", "triangle"), ("cfl", "cycle4"), ("dpiso", "path3"), ("ceci", "cycle4"), ("veq", "tree5")):
    _add(f"filter_{_filter}", _filtered(_filter, _on), filter_sql(_filter, _on, 0))
for _filter in ("tso", "cfl", "dpiso", "ceci", "veq"):
    # a named filter may be looser than the fixpoint, never wrong: the matches are the same under it
    _add(f"match_filtered_{_filter}", _graph(lambda g, p, x=_filter: match.top_k(g, p, K, cands=filters.run(x, g, p))), match_sql("path2"))


def _ordered(name: str, by: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, p = fixture.vector_graph(spark, sf_dir), pattern(spark, sf_dir, name)
        return match.top_k(g, p, K, order=orders.order(by, p, orders.statistics(g, p, match.candidates_of(g, p))))

    return query


for _order, _on in (("gql", "path2"), ("qsi", "triangle"), ("cfl", "cycle4"), ("ri", "star3"), ("vf2pp", "tree5")):
    _add(f"match_order_{_order}", _ordered(_on, _order), match_sql(_on))
_add(
    "candidate_edges", _graph(lambda g, p: filters.candidate_edges(g, p, filters.run("rm", g, p))),
    f"WITH {GRAPH}, {_CFL} SELECT 0 AS eid, v, w FROM a WHERE rel = '{URGENT}' AND v IN (SELECT v FROM x0) AND w IN (SELECT v FROM m) UNION ALL SELECT 1, v, w FROM a WHERE rel = '{HIGH}' AND v IN (SELECT v FROM m) AND w IN (SELECT v FROM x2)",
)
_add("composite_labels", _graph(lambda g, p: filters.composite_labels(g)), f"WITH {GRAPH} SELECT v, CAST(dense_rank() OVER (ORDER BY list_sort(types)) AS INTEGER) AS label FROM ty")
_add("edge_lookup", _graph(lambda g, p: g.edges.where((F.col("src") == 4) & (F.col("rel") == LOW)).select("src", "rel", "dst")), f"WITH {GRAPH} SELECT src, rel, dst FROM e WHERE src = 4 AND rel = '{LOW}'")


def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v): the node nearest to the mean vector, ties to the smaller id."""
    emb = fixture.read(spark, sf_dir, "embeddings")
    mean = emb.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    centre = [r["m"] for r in mean.first()["m"]]  # one value per dimension
    return emb.select(F.col("vec_id").alias("v"), F.round(vector.l2(F.col("embedding"), centre), 6).alias("d")).orderBy("d", "v").limit(1)


_add("medoid", medoid, "WITH x AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM m) SELECT vec_id AS v, round(list_distance(CAST(embedding AS DOUBLE[]), c), 6) AS d FROM embeddings, c ORDER BY d, v LIMIT 1")

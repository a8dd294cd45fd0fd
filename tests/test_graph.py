"""Hand-made graphs of a few nodes, random graphs against brute force, loaders, and every query against its SQL."""

import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.operators import bounds, candidates, cores, filters, match, nuclei, orders, paths, text, updates
from graphloom.operators import triples as t
from graphloom.operators.graph import Graph
from graphloom.operators.pattern import Pattern, merged
from graphloom.sources import directories, versions

SMALL = "/root/testdata/sf0.001"


def graph(spark, points, edges):
    nodes = spark.createDataFrame([(i, p, [i % 2, 2 + i % 3]) for i, p in enumerate(points)], "v long, emb array<float>, types array<int>")
    return Graph(nodes, spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "edge_id long, src long, rel string, dst long"))


def brute(points, edges, p, k, directed=False, injective=True):
    have = {(s, r, d) for s, r, d in edges}
    out = []
    for m in itertools.product(range(len(points)), repeat=p.nodes):
        if injective and len(set(m)) < p.nodes:
            continue
        if all((m[a], r, m[b]) in have or not directed and (m[b], r, m[a]) in have for a, r, b in p.edges):
            out.append((round(sum(math.dist(points[m[u]], q) for u, q in p.vectors.items()), 6), *m))
    return sorted(out)[:k]


def rows(df, n):
    return [(r["score"], *[r[f"v{u}"] for u in range(n)]) for r in df.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    points = [[float(rng.randrange(8)), float(rng.randrange(8))] for _ in range(8)]
    edges = sorted({(rng.randrange(8), rng.choice("ab"), rng.randrange(8)) for _ in range(24)})
    p = Pattern(3, ((0, "a", 1), (1, "b", 2), *([(2, "a", 0)] if seed == 2 else [])), {0: [1.0, 1.0], 1: [4.0, 4.0], 2: [7.0, 0.0]})
    g = graph(spark, points, edges)
    for directed in (False, True):
        assert rows(match.top_k(g, p, 4, directed), 3) == brute(points, edges, p, 4, directed)
    assert rows(match.top_k(g, p, 4, injective=False), 3) == brute(points, edges, p, 4, injective=False)
    refined = candidates.refine(g, p, match.candidates_of(g, p))
    assert rows(match.top_k(g, p, 4, cands=refined), 3) == brute(points, edges, p, 4)
    low = {r["v"]: r["b"] for r in bounds.best_below(g, p, refined, 0)[0].collect()}
    for score, *m in brute(points, edges, p, 100):
        assert low[m[0]] <= score + 1e-6


def test_semantics(spark):
    points = [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [3.0, 0.0]]
    edges = [(1, "a", 0), (0, "a", 0), (1, "b", 2), (2, "a", 3), (2, "b", 3)]
    g = graph(spark, points, edges)
    one = Pattern(2, ((0, "a", 1),), {0: [0.0, 0.0], 1: [1.0, 0.0]})
    assert rows(match.top_k(g, one, 1), 2) == [(0.0, 0, 1)]  # the edge exists in reverse only
    assert rows(match.top_k(g, one, 1, directed=True), 2) == [(2.0, 1, 0)]
    assert rows(match.top_k(g, one, 1, injective=False, directed=True), 2) == [(1.0, 0, 0)]
    both = Pattern(2, ((0, "a", 1), (0, "b", 1)), {0: [0.0, 0.0], 1: [0.0, 0.0]})
    assert [r[1:] for r in rows(match.top_k(g, both, 9), 2)] == [(2, 3), (3, 2)]
    assert len(rows(match.top_k(g, both, 9, label_sets=True), 2)) == 6
    loop = Pattern(2, ((0, "a", 0), (0, "a", 1)), {1: [1.0, 0.0]})
    assert rows(match.top_k(g, loop, 3), 2) == [(0.0, 0, 1)]
    none = Pattern(2, ((0, "zz", 1),), {0: [0.0, 0.0]})
    assert rows(match.top_k(g, none, 3), 2) == []
    assert match.count_matches(g, both).first()["n"] == 2
    assert {r["v"]: r["degree"] for r in g.degrees().collect()} == {0: 3, 1: 2, 2: 3, 3: 2}
    assert {r["v"] for r in filters.ldf(g, one, 0).collect()} == {0, 1, 2, 3}


def test_pattern():
    p = Pattern(4, ((0, "a", 1), (0, "a", 2), (0, "b", 3), (1, "a", 1)))
    assert p.cover() == [0] and p.degree(0) == 3 and p.order()[0] == 0
    assert p.requirements(0, False) == {("any", "a"): 2, ("any", "b"): 1}
    assert Pattern(1, ()).cover() == [0]
    assert merged(["x", "y", "x"], [(0, "r", 1), (1, "r", 2), (0, "r", 9)], {2: [1.0]}) == Pattern(2, ((0, "r", 1), (1, "r", 0)), {0: [1.0]})


def test_budget_before_filter(spark):
    g = graph(spark, [[float(i), 0.0] for i in range(8)], [(5, "a", 6), (6, "a", 7)])
    p = Pattern(2, ((0, "a", 1),), {0: [0.0, 0.0], 1: [6.0, 0.0]})
    assert [r["v"] for r in candidates.cover_candidates(g, p, 3)[0].collect()] == []  # the three nearest have no edge
    assert sorted(r["v"] for r in candidates.cover_candidates(g, p, 6)[0].collect()) == [5]


def test_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0],)], "a array<float>")
    assert [r[0] for r in df.select(vector.l2(F.col("a"), [4.0, 6.0])).collect()][0] == 5.0
    assert vector.metric_name("SqEuclidean") == "squared-l2"
    with pytest.raises(ValueError):
        vector.metric_name("x")


def test_paths(spark):
    g = graph(spark, [[0.0, 0.0]] * 6, [(0, "a", 1), (1, "a", 2), (2, "a", 0), (3, "a", 4)])
    pairs = spark.createDataFrame([(0, 2), (0, 4)], "a long, b long")
    assert {(r["a"], r["b"]): r["length"] for r in paths.shortest_length(g, pairs, directed=True).collect()} == {(0, 2): 2, (0, 4): None}
    assert {(r["a"], r["b"]): r["cycle"] for r in paths.on_cycle(g, pairs).collect()} == {(0, 2): True, (0, 4): False}
    assert [r["v"] for r in paths.shortest_path(g, 0, 2, directed=True).collect()] == [0, 1, 2]


def test_algebra(spark):
    x = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("a", "n", "3"), ("b", "n", "x"), ("c", "n", "5")], "s string, p string, o string")
    two = t.bgp(x, [("?x", "p", "?y"), ("?y", "p", "?z")])
    assert [tuple(r[c] for c in "xyz") for r in two.collect()] == [("a", "b", "c")]
    assert t.aggregate(t.bgp(x, [("?x", "n", "?v")]), [], n=("count", "*"), s=("sum", "v")).first() == (3, 8.0)
    assert [r["x"] for r in t.top_k(t.bgp(x, [("?x", "n", "?v")]), "?v", 5).collect()] == ["a", "c"]
    assert t.minus(two, t.bgp(x, [("?q", "n", "?v")])).count() == 1
    assert t.coefficients("?x + 2*?y - ?z") == {"x": 1.0, "y": 2.0, "z": -1.0}
    part = spark.createDataFrame([("a", None), ("b", "1")], "x string, y string")
    assert t.compatible(part, spark.createDataFrame([("2",)], "y string")).collect() == [("a", "2")]


@pytest.mark.parametrize("seed", range(2))
def test_cores(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(9), rng.choice("ab"), rng.randrange(9)) for _ in range(30)})
    g = graph(spark, [[0.0, 0.0]] * 10, edges)  # node 9 is alone
    near = {v: {b if a == v else a for a, _, b in edges if v in (a, b)} - {v} for v in range(10)}
    by_hand = {}
    for k in range(10):
        alive = set(range(10))
        while gone := {v for v in alive if len(near[v] & alive) < k}:
            alive -= gone
        by_hand |= {v: k for v in alive}
    assert {r["v"]: r["core"] for r in cores.core_numbers(g).collect()} == by_hand
    top = max(by_hand.values())
    inside = {v for v, k in by_hand.items() if k >= top}
    got = cores.k_core(g, top)
    assert {r["v"] for r in got.nodes.collect()} == inside
    assert sorted((r["src"], r["rel"], r["dst"]) for r in got.edges.collect()) == [e for e in edges if e[0] in inside and e[2] in inside]


def test_updates(spark):
    make = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    x = make([("a", "p", "b"), ("b", "p", "c"), ("c", "q", "a")])
    assert got(updates.insert(x, make([("a", "p", "b"), ("d", "p", "a"), ("d", "p", "a"), ("d", None, "a")]))) == [("a", "p", "b"), ("b", "p", "c"), ("c", "q", "a"), ("d", "p", "a")]
    assert got(updates.delete(x, make([("a", "p", "b"), ("x", "p", "y")]))) == [("b", "p", "c"), ("c", "q", "a")]
    assert got(updates.delete(x, make([]))) == got(x)
    assert got(updates.modify(x, [("?x", "p", "?y")], [("?x", "p", "?y")], [("?y", "p", "?x"), ("b", "p", "c")])) == [("b", "p", "a"), ("b", "p", "c"), ("c", "p", "b"), ("c", "q", "a")]
    log = spark.createDataFrame([(1, "-", "a", "p", "b"), (2, "+", "a", "p", "b"), (3, "-", "b", "p", "c"), (1, "+", "n", "p", "n"), (1, "-", "n", "p", "n")], "seq int, op string, s string, p string, o string")
    assert got(updates.replay(x, log)) == [("a", "p", "b"), ("c", "q", "a"), ("n", "p", "n")]


def test_compact_folder(spark, tmp_path):
    (tmp_path / "stats.txt").write_text("node_num=2\nrelation_num=1\nedge_num=1\n")
    (tmp_path / "node_names.txt").write_text("a\r\n\nb\n")
    (tmp_path / "relation_names.txt").write_text("likes\n")
    (tmp_path / "edges.txt").write_text("0\t0\t1\n")
    (tmp_path / "node_embeddings.bin").write_bytes(struct.pack("<2I4f", 2, 2, 1, 2, 3, 4))
    got = directories.load(spark, str(tmp_path))
    assert [(r["src"], r["rel"], r["dst"]) for r in got["edges"].collect()] == [(0, "likes", 1)]
    assert {r["name"]: list(r["emb"]) for r in got["nodes"].collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    (tmp_path / "edges.txt").write_text("0\t0\t7\n")
    with pytest.raises(ValueError):
        directories.load(spark, str(tmp_path))


def test_named_folder(spark, tmp_path):
    (tmp_path / "FactKG.graph.txt").write_text("a\tlikes\tb\n")
    (tmp_path / "relation_name_to_id.txt").write_text("likes\t0\n")
    (tmp_path / "type_name_to_id.txt").write_text("T\t0\n")
    (tmp_path / "FactKG.type_to_nodes.txt").write_text("T\ta\nT\tzzz\n")
    (tmp_path / "node_name_to_id").mkdir()
    (tmp_path / "node_name_to_id" / "0.txt").write_text("a\t0\nb\t1\n")
    (tmp_path / "node_embeddings").mkdir()
    rec = b"".join(struct.pack("<2I", i, 1) + n + struct.pack("<2f", i, 9) for i, n in ((0, b"a"), (1, b"b")))
    (tmp_path / "node_embeddings" / "0.bin").write_bytes(b"EMBEDBIN" + struct.pack("<QI", 2, 2) + rec)
    got = directories.load(spark, str(tmp_path))
    assert [(r["src"], r["rel"], r["dst"]) for r in got["edges"].collect()] == [(0, "likes", 1)]
    assert {r["name"]: list(r["emb"]) for r in got["nodes"].collect()} == {"a": [0.0, 9.0], "b": [1.0, 9.0]}
    assert [tuple(r) for r in got["node_types"].collect()] == [(0, 0)]


def test_ntriples(spark):
    e = spark.createDataFrame([("a b", "r/x", "ü")], "src_name string, rel string, dst_name string")
    lines = directories.ntriples(e)
    assert lines.first()["line"] == "<a%20b> <r%2Fx> <%C3%BC> ."
    assert directories.parse_ntriples(lines.withColumnRenamed("line", "value")).collect() == [("a b", "r/x", "ü")]


@pytest.mark.parametrize("name", ["match_path2_topk", "match_triangle", "homomorphic_star3", "refine_fixpoint", "leaf_cap", "lb_prune", "match_edges", "group_agg", "khop_directed", "medoid", "candidate_edges", "update_modify", "update_log", "core_numbers", "truss_numbers", "triangle_nuclei"])
def test_against_sql(spark, name):
    import duckdb

    from graphloom.plans import registry

    c = duckdb.connect()
    for table in ("embeddings", "orders", "customer", "nation", "region", "supplier"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    show = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    got = sorted(tuple(show(r[k]) for k in columns) for r in df.collect())
    cur = c.execute(registry.SQL[name])
    at = [[d[0] for d in cur.description].index(k) for k in columns]
    assert got == sorted(tuple(show(r[i]) for i in at) for r in cur.fetchall())


def test_feed(spark, tmp_path):
    from graphloom.streaming import feed

    g = graph(spark, [[0.0, 0.0], [1.0, 0.0]], [(0, "a", 1)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"query_id": "q", "pattern": "{\\"nodes\\": 2, \\"edges\\": [[0, \\"a\\", 1]], \\"vectors\\": {\\"0\\": [0, 0]}}"}')
    q = feed.start(spark.readStream.schema("query_id string, pattern string").json(str(tmp_path / "in")), g, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r["rank"], list(r["nodes"])) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("rank").collect()] == [(1, [0, 1]), (2, [1, 0])]


def peeled(pairs, r):
    """Nucleus numbers by taking away the clique of the fewest larger ones, again and again."""
    nodes, have = sorted({v for p in pairs for v in p}), {frozenset(p) for p in pairs}
    of = lambda n: [c for c in itertools.combinations(nodes, n) if all(frozenset(x) in have for x in itertools.combinations(c, 2))]
    left, larger, out, level = set(of(r)), set(of(r + 1)), {}, 0
    while left:
        load = {c: sum(set(c) <= set(s) for s in larger) for c in left}
        c = min(left, key=load.__getitem__)
        level = max(level, load[c])
        out[c] = level
        left.remove(c)
        larger = {s for s in larger if not set(c) <= set(s)}
    return out


@pytest.mark.parametrize("r", [1, 2, 3])
def test_nuclei(spark, r):
    rng = random.Random(r)
    pairs = [p for p in itertools.combinations(range(9), 2) if rng.random() < 0.7]
    g = graph(spark, [[0.0]] * 9, [(a, "x", b) if rng.random() < 0.5 else (b, "y", a) for a, b in pairs] + [(4, "x", 4), (pairs[0][1], "z", pairs[0][0])])
    got = {tuple(x["s"]): x["n"] for x in nuclei.nucleus_numbers(g, r).collect()}
    assert {c: n for c, n in got.items() if r > 1 or n} == peeled(pairs, r)
    if r == 1:
        assert got == {(x["v"],): x["core"] for x in cores.core_numbers(g).collect()}


def test_k_truss(spark):
    g = graph(spark, [[0.0]] * 5, [(0, "a", 1), (1, "a", 2), (2, "b", 0), (0, "c", 1), (2, "a", 3), (4, "a", 4)])
    sub = nuclei.k_truss(g, 3)
    assert sorted(x["edge_id"] for x in sub.edges.collect()) == [0, 1, 2, 3]
    assert sorted(x["v"] for x in sub.nodes.collect()) == [0, 1, 2]
    assert nuclei.truss_numbers(graph(spark, [[0.0]] * 2, [(0, "a", 0)])).collect() == []


def test_versions(spark, tmp_path):
    f = str(tmp_path / "store")
    make = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    with pytest.raises(FileNotFoundError):
        versions.restore(spark, f)
    versions.backup(make([("a", "p", "b"), ("c", "p", "d")]), f, 0)
    assert versions.restore(spark, f).count() == 2
    versions.record(spark.createDataFrame([(1, "-", "a", "p", "b"), (2, "+", "e", "p", "f")], versions.LOG), f)
    versions.record(spark.createDataFrame([(3, "+", "a", "p", "b")], versions.LOG), f)
    state = lambda seq=None: sorted(x["s"] for x in versions.restore(spark, f, seq).collect())
    assert [state(0), state(1), state(2), state()] == [["a", "c"], ["c"], ["c", "e"], ["a", "c", "e"]]
    versions.backup(versions.restore(spark, f, 2), f, 2)
    (tmp_path / "store" / "upto=3").mkdir()  # one that was cut short
    assert versions.backups(spark, f) == [0, 2] and state() == ["a", "c", "e"] and state(1) == ["c"]


def test_command_line(spark, tmp_path, capsys):
    import json

    from graphloom import __main__ as cli

    d = tmp_path / "g"
    d.mkdir()
    (d / "stats.txt").write_text("node_num=3\nrelation_num=1\nedge_num=2\n")
    (d / "node_names.txt").write_text("a\nb\nc\n")
    (d / "relation_names.txt").write_text("likes\n")
    (d / "edges.txt").write_text("0\t0\t1\n1\t0\t2\n")
    (tmp_path / "p.txt").write_text(json.dumps({"nodes": 2, "edges": [[0, "likes", 1]]}) + "\n")
    cli.main(["match", str(d), str(tmp_path / "p.txt"), "-k", "5", "--directed"])
    out = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert [x["nodes"] for x in out["matches"]] == [[0, 1], [1, 2]] and not out["timeout"]
    slow = spark.range(0, 1 << 50, 1, 8).selectExpr("max(hash(id)) AS h")
    assert cli.within(spark, 1.0, "slow", lambda: slow) is None
    (tmp_path / "t.nt").write_text("<a> <p> <b> .\n<a> <p> <b> .\n")
    cli.main(["backup", str(tmp_path / "t.nt"), str(tmp_path / "s")])
    cli.main(["restore", str(tmp_path / "s"), str(tmp_path / "o")])
    assert [tuple(x) for x in spark.read.parquet(str(tmp_path / "o")).collect()] == [("a", "p", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_filters_and_orders(spark, seed):
    """Every filter keeps every node of a match and agrees with matching by brute force; every order gives the same matches."""
    r = random.Random(seed)
    points = [[r.random(), r.random()] for _ in range(9)]
    edges = list({(r.randrange(9), r.choice("ab"), r.randrange(9)) for _ in range(22)})
    g = graph(spark, points, edges)
    p = [Pattern(4, ((0, "a", 1), (0, "a", 2), (0, "b", 3))), Pattern(4, ((0, "a", 1), (1, "b", 2), (2, "a", 3), (3, "b", 0))), Pattern(3, ((0, "a", 1), (1, "a", 2), (2, "b", 0)))][seed]
    p = Pattern(p.nodes, p.edges, {u: [r.random(), r.random()] for u in range(p.nodes)})
    best = brute(points, edges, p, 5)
    used = {u: {m[u + 1] for m in brute(points, edges, p, 10**6)} for u in range(p.nodes)}
    near = {(x, rel): {b if a == x else a for a, q, b in edges if q == rel and x in (a, b)} - {x} for x in range(9) for rel in "ab"}
    every = {u: set(range(9)) for u in range(p.nodes)}
    for u in range(p.nodes):
        ws = [(w, rel) for a, rel, b in p.edges for w in [b if a == u else a] if u in (a, b)]
        want = {v for v in range(9) if any(len(set(c)) == len(c) for c in itertools.product(*[near[v, rel] & every[w] for w, rel in ws]))}
        assert {x["v"] for x in filters.matchable(g, p, u, tuple(w for w, _ in ws), match.candidates_of(g, p)).collect()} == want
    for name in ("gql", "calig", "tso", "cfl", "dpiso", "ceci", "veq", "rm"):
        got = filters.run(name, g, p)
        kept = candidates.flat(got).collect()
        assert all(used[u] <= {x["v"] for x in kept if x["u"] == u} for u in used), name
    s = orders.statistics(g, p, match.candidates_of(g, p))
    for name in orders.ORDERS:
        assert rows(match.top_k(g, p, 5, order=orders.order(name, p, s)), p.nodes) == best, name
    for order in orders.spectrum(p, 3):
        assert orders.valid(p, order)
        assert rows(match.top_k(g, p, 5, order=order), p.nodes) == best


def test_order_rules():
    """Two triangles with a tail and a part of its own; counts decide where structure does not."""
    p = Pattern(7, ((0, "a", 1), (1, "a", 2), (2, "a", 0), (2, "a", 3), (3, "a", 4), (5, "a", 6)))
    s = orders.Statistics({0: 50, 1: 40, 2: 30, 3: 20, 4: 10, 5: 5, 6: 7}, {(0, 1): 90, (1, 2): 80, (0, 2): 70, (2, 3): 60, (3, 4): 5, (5, 6): 50})
    assert orders.gql(p, s) == [5, 6, 4, 3, 2, 1, 0]
    assert orders.qsi(p, s)[:4] == [3, 4, 2, 0]
    assert orders.ri(p, s)[0] == 2
    assert set(orders.cfl(p, s)[:3]) == {0, 1, 2}
    assert all(orders.valid(p, orders.order(name, p, s)) for name in orders.ORDERS)
    assert len(orders.spectrum(Pattern(3, ((0, "a", 1), (1, "a", 2))), 99)) == 4
    assert not orders.valid(p, [0, 1, 2, 3, 4, 5]) and not orders.valid(p, [0, 4, 1, 2, 3, 5, 6])


def test_text(spark):
    """Texts against results counted by hand, and what is refused."""
    x = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("a", "age", "30"), ("b", "age", "9"), ("c", "age", "old"), ("c", "nick", 'say "c"')], "s string, p string, o string")
    got = lambda q: [tuple(r) for r in text.run(x, q).collect()]
    assert sorted(got("SELECT ?x ?y WHERE { ?x knows ?y }")) == [("a", "b"), ("b", "c")]
    assert got("SELECT ?x { ?x age ?n FILTER(?n > 8) } ORDER BY ?n") == [("b",), ("a",)]  # by number; what is none is refused
    assert got("SELECT ?x { ?x age ?n } ORDER BY DESC(?n) LIMIT 1 OFFSET 1") == [("b",)]
    assert got("SELECT ?x ?k { ?x age ?n OPTIONAL { ?x nick ?k } FILTER(BOUND(?k)) }") == [("c", 'say "c"')]
    assert got("SELECT ?x { ?x nick \"say \\\"c\\\"\" }") == [("c",)]
    assert got("SELECT ?x { ?x age ?n MINUS { ?x knows ?y } }") == [("c",)]
    assert sorted(got("SELECT ?x ?a { { ?x knows <b> } UNION { ?x nick ?a } }"), key=str) == [("a", None), ("c", 'say "c"')]
    assert got("SELECT (COUNT(DISTINCT ?y) AS ?n) (SUM(?a) / COUNT(*) AS ?m) { ?x knows ?y ; age ?a }") == [(2, 19.5)]
    assert got("SELECT DISTINCT ?p { ?x ?p ?o FILTER(STRSTARTS(?p, \"k\") || !(?p != \"nick\")) } ORDER BY ?p") == [("knows",), ("nick",)]
    assert got("SELECT ?x ?z { ?x knows ?y BIND(UCASE(?y) AS ?z) FILTER(-1 < 0 && STRLEN(?z) = 1) } ORDER BY ?x") == [("a", "B"), ("b", "C")]
    assert got("SELECT ?x ?q { ?x nick ?k }") == [("c", None)]
    assert got("ASK { c knows ?x }") == [(False,)]
    assert text.run(x, "INSERT { ?y knownby ?x } WHERE { ?x knows ?y }").count() == 8
    assert text.run(x, "DELETE { ?x age ?n } WHERE { ?x age ?n FILTER(?n < 10) }").count() == 5
    for bad in (
        "SELECT * { ?x age ?n } GROUP BY ?x", "SELECT ?n { ?x age ?n } GROUP BY ?x", "SELECT ?x { ?x ?p ?y . ?p knows ?z }", "SELECT ?x { ?x age", "SELECT { ?x age ?n }",
        "SELECT ?x { ?x age ?n } LIMIT 1.5", "FIND ?x", "SELECT ?x { FILTER(?x > 1) }", "SELECT ?x { ?x age ?n FILTER(SOUNDS(?n)) }", "SELECT ?x { ?x age ?n FILTER(?n) }", "SELECT ?x { ?x age ?n } junk", "SELECT ?x { ?x age @ }",
    ):
        with pytest.raises(text.QueryError):
            text.run(x, bad)
    p = Pattern(3, ((0, "knows", 1), (1, "age", 2)))
    assert text.of_pattern(p, 3) == 'SELECT ?v0 ?v1 ?v2 WHERE { ?v0 "knows" ?v1 . ?v1 "age" ?v2 } ORDER BY DESC(?v0 + ?v1 + ?v2) LIMIT 3'
    assert got(text.of_pattern(p, 3)) == [("a", "b", "9"), ("b", "c", "old")]


def test_result_lines(spark):
    rows = [(1, 0, 0.5, 7, 2, 3, "g", "r", "c"), (1, 1, 0.5, 3, None, 4, "c", "s", "d"), (2, 0, 1 / 3, 1, 1, 2, "a", directories.RDF_TYPE, "b")]
    df = spark.createDataFrame(rows, "rank int, eid int, score double, src long, rel_id int, dst long, src_name string, rel string, dst_name string")
    lines = lambda layout: [r["line"] for r in directories.result_lines(df, layout).collect()]
    assert lines("known")[0] == "0.5|7---2---3|g---r---c|3---0---4|c---UNKNOWN_REL---d"
    assert lines("sorted")[0].startswith("0.5|3---2---7|c---r---g|")
    assert lines("plain")[1] == f"0.33333333|1---1---2|a---{directories.RDF_TYPE}---b"
    assert lines("ranked")[1] == "2  0.333333333"


def test_query_folders(spark, tmp_path):
    for path in ("2", "10", "n8/1", "n4/3", "n4/x", "other/1", ".hidden/1", "empty"):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "edges.txt").write_text("")
    (tmp_path / "5").mkdir()
    got = [(s, n) for s, n, _ in directories.query_folders(spark, str(tmp_path))]
    assert got == [("queries", 2), ("queries", 10), ("n4", 3), ("n8", 1), ("other", 1)]

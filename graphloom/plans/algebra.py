"""Triple-pattern and path queries, each with a plain SQL statement of the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import paths, text
from graphloom.operators import triples as t
from graphloom.plans.matching import GRAPH, HIGH, LOW, URGENT
from graphloom.sources import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(fixture.triple_graph(spark, sf_dir))
    SQL[name] = sql


_C = [("?c", "in_nation", "?n"), ("?c", "segment", "?g")]
_CSQL = "SELECT concat('c', c_custkey) AS c, concat('n', c_nationkey) AS n, c_mktsegment AS g FROM customer"
_add("bgp_join", lambda x: t.bgp(x, [*_C, ("?n", "in_region", "?r")]), f"SELECT x.*, concat('r', n_regionkey) AS r FROM ({_CSQL}) x JOIN nation ON concat('n', n_nationkey) = x.n")
_add("bgp_constant", lambda x: t.bgp(x, [("?c", "segment", "BUILDING"), ("?c", "in_nation", "n3")]), "SELECT concat('c', c_custkey) AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
_add("optional", lambda x: t.optional(t.bgp(x, _C).select("c", "n"), t.bgp(x, [("?o", "placed_by", "?c")])), "SELECT concat('c', c_custkey) AS c, concat('n', c_nationkey) AS n, CASE WHEN o_orderkey IS NULL THEN NULL ELSE concat('o', o_orderkey) END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
_add("minus", lambda x: t.minus(t.bgp(x, _C).select("c", "n"), t.bgp(x, [("?o", "placed_by", "?c"), ("?o", "priority", URGENT)])), "SELECT concat('c', c_custkey) AS c, concat('n', c_nationkey) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
_add("union", lambda x: t.union(t.bgp(x, [("?c", "segment", "?g")]), t.bgp(x, [("?s", "in_nation", "?n"), ("?n", "in_region", "?r")])), "SELECT concat('c', c_custkey) AS c, c_mktsegment AS g, NULL AS s, NULL AS n, NULL AS r FROM customer UNION ALL SELECT NULL, NULL, k, n, concat('r', n_regionkey) FROM (SELECT concat('s', s_suppkey) AS k, concat('n', s_nationkey) AS n FROM supplier UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer) JOIN nation ON concat('n', n_nationkey) = n")
_add("filter", lambda x: t.bgp(x, [("?o", "total", "?v"), ("?o", "priority", "?p")]).where((t.number("v") > 200000) & (F.col("p") != LOW)).select("o", "p"), f"SELECT concat('o', o_orderkey) AS o, o_orderpriority AS p FROM orders WHERE o_totalprice > 200000 AND o_orderpriority <> '{LOW}'")
_add("bind", lambda x: t.bind(t.bind(t.bgp(x, [("?c", "segment", "?g")]), "g", "BUILDING"), "kind", "customer"), "SELECT concat('c', c_custkey) AS c, c_mktsegment AS g, 'customer' AS kind FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("contains", lambda x: t.bgp(x, [("?c", "segment", "?g")]).select("c", F.contains("g", F.lit("UI")).alias("has")), "SELECT concat('c', c_custkey) AS c, contains(c_mktsegment, 'UI') AS has FROM customer")
_add("arithmetic", lambda x: t.bgp(x, [("?c", "balance", "?b")]).where("c LIKE 'c%'").select("c", F.round(t.number("b") * 2 + 1, 4).alias("x")), "SELECT concat('c', c_custkey) AS c, round(c_acctbal * 2 + 1, 4) AS x FROM customer")
_ORDERS = [("?o", "placed_by", "?c"), ("?c", "in_nation", "?n"), ("?o", "total", "?v")]
_OSQL = "FROM orders JOIN customer ON o_custkey = c_custkey"
_add("group_agg", lambda x: t.aggregate(t.bgp(x, _ORDERS), ["n"], orders=("count", "*"), total=("sum", "v"), mean=("avg", "v"), least=("min", "v"), most=("max", "v")).select("n", "orders", *[F.round(c, 2).alias(c) for c in ("total", "mean", "least", "most")]), f"SELECT concat('n', c_nationkey) AS n, count(*) AS orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most {_OSQL} GROUP BY c_nationkey")
_add("agg_distinct", lambda x: t.aggregate(t.bgp(x, [("?o", "placed_by", "?c"), ("?o", "priority", "?p")]), ["p"], customers=("count_distinct", "c"), solutions=("count_distinct", "*")), "SELECT o_orderpriority AS p, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderkey) AS solutions FROM orders GROUP BY 1")
_add("distinct", lambda x: t.bgp(x, [("?c", "in_nation", "?n"), ("?c", "segment", "?g")]).select("n", "g").distinct(), "SELECT DISTINCT concat('n', c_nationkey) AS n, c_mktsegment AS g FROM customer")
_add("order_limit_offset", lambda x: t.bgp(x, [("?o", "total", "?v")]).select("o", F.round(t.number("v"), 2).alias("v")).orderBy(F.desc("v"), "o").offset(5).limit(20), "SELECT concat('o', o_orderkey) AS o, round(o_totalprice, 2) AS v FROM orders ORDER BY v DESC, o LIMIT 20 OFFSET 5")
_add("ask", lambda x: t.ask(t.bgp(x, [("?c", "segment", "MACHINERY"), ("?c", "in_nation", "n1")])), "SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 1")
_add("topk_linear_score", lambda x: t.top_k(t.bgp(x, [("?o", "placed_by", "?c"), ("?o", "total", "?v"), ("?c", "balance", "?b")]), "?v + 2*?b", 10, True).select("o", "c", F.round("score", 4).alias("score")), "SELECT concat('o', o_orderkey) AS o, concat('c', c_custkey) AS c, round(round(o_totalprice + 2 * c_acctbal, 6), 4) AS score FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY round(o_totalprice + 2 * c_acctbal, 6) DESC, o LIMIT 10")
_TOTALS = {"in_region": "nation", "name": "(SELECT 1 FROM nation UNION ALL SELECT 1 FROM region)", "in_nation": "(SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier)", "balance": "(SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier)", "segment": "customer", "placed_by": "orders", "total": "orders", "priority": "orders"}


def _counts(**changed: str) -> str:
    """Rows of every predicate, those of ``changed`` ones by another table."""
    return " UNION ALL ".join(f"SELECT '{p}' AS p, count(*) AS n FROM {source}" for p, source in {**_TOTALS, **changed}.items())


def _per_predicate(x: DataFrame) -> DataFrame:
    return x.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_add("insert_where", lambda x: _per_predicate(t.insert(x, t.construct(t.bgp(x, [("?n", "in_region", "?r")]), [("?r", "has", "?n")]))), _counts(has="nation"))
_add("delete_where", lambda x: _per_predicate(t.delete(x, t.construct(t.bgp(x, [("?c", "segment", "BUILDING")]), [("?c", "segment", "BUILDING")]))), _counts(segment="(SELECT 1 FROM customer WHERE c_mktsegment <> 'BUILDING')"))
_add("predicate_counts", _per_predicate, _counts())
_VALUES = """SELECT concat('c', c_custkey) AS e, 'balance' AS p, c_acctbal AS x, concat('c', c_custkey) AS w FROM customer UNION ALL SELECT concat('s', s_suppkey), 'balance', s_acctbal, concat('s', s_suppkey) FROM supplier
UNION ALL SELECT concat('o', o_orderkey), 'total', o_totalprice, concat('o', o_orderkey) FROM orders UNION ALL SELECT concat('o', o_orderkey), 'placed_by/balance', c_acctbal, concat('c', c_custkey) FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('c', o_custkey), '^placed_by/total', o_totalprice, concat('o', o_orderkey) FROM orders UNION ALL SELECT concat('n', c_nationkey), '^in_nation/balance', c_acctbal, concat('c', c_custkey) FROM customer
UNION ALL SELECT concat('n', s_nationkey), '^in_nation/balance', s_acctbal, concat('s', s_suppkey) FROM supplier"""
_add(
    "hop_index", lambda x: t.hop_index(x).select("e", "p", *[F.round(c, 2).alias(c) for c in ("least", "most", "second")], "witness", "second_witness"),
    f"WITH v AS ({_VALUES}), r AS (SELECT *, row_number() OVER (PARTITION BY e, p ORDER BY x DESC, w) AS r FROM v) SELECT e, p, round(min(x), 2) AS least, round(max(x), 2) AS most, round(max(x) FILTER (r = 2), 2) AS second, max(w) FILTER (r = 1) AS witness, max(w) FILTER (r = 2) AS second_witness FROM r GROUP BY e, p",
)
_add("dictionary_size", lambda x: t.dictionary(x).agg(F.count_distinct("id").alias("n")), """SELECT (SELECT count(*) FROM (SELECT unnest(['in_region', 'name', 'in_nation', 'balance', 'segment', 'placed_by', 'total', 'priority']) UNION SELECT concat('n', n_nationkey) FROM nation UNION SELECT n_name FROM nation UNION SELECT concat('r', n_regionkey) FROM nation
UNION SELECT concat('r', r_regionkey) FROM region UNION SELECT r_name FROM region UNION SELECT concat('c', c_custkey) FROM customer UNION SELECT concat('n', c_nationkey) FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT concat('s', s_suppkey) FROM supplier UNION SELECT concat('n', s_nationkey) FROM supplier
UNION SELECT concat('o', o_orderkey) FROM orders UNION SELECT concat('c', o_custkey) FROM orders UNION SELECT o_orderpriority FROM orders)) + (SELECT count(*) FROM (SELECT c_acctbal FROM customer UNION SELECT s_acctbal FROM supplier UNION SELECT o_totalprice FROM orders)) AS n""")



def _text(name: str, query: str, sql: str, *rounded: str) -> None:
    """A query as text; ``rounded`` columns are rounded for the comparison."""
    _add(name, lambda x: (lambda out: out.select(*[F.round(c, 2).alias(c) if c in rounded else c for c in out.columns]))(text.run(x, query)), sql)


_text("text_join", "SELECT * WHERE { ?c in_nation ?n ; segment ?g . ?n in_region ?r }", SQL["bgp_join"])
_text("text_optional", "SELECT ?c ?n ?o { ?c in_nation ?n . ?c segment ?g OPTIONAL { ?o placed_by ?c } }", SQL["optional"])
_text("text_minus", f'SELECT ?c ?n {{ ?c in_nation ?n ; segment ?g MINUS {{ ?o placed_by ?c ; priority "{URGENT}" }} }}', SQL["minus"])
_text("text_union", "SELECT * { { ?c segment ?g } UNION { ?s in_nation ?n . ?n in_region ?r } }", SQL["union"])
_text("text_filter", f'SELECT ?o ?p {{ ?o total ?v ; priority ?p FILTER(?v > 200000 && ?p != "{LOW}") }}', SQL["filter"])
_text("text_group", "SELECT ?n (COUNT(*) AS ?orders) (SUM(?v) AS ?total) (AVG(?v) AS ?mean) (MIN(?v) AS ?least) (MAX(?v) AS ?most) { ?o placed_by ?c . ?c in_nation ?n . ?o total ?v } GROUP BY ?n", SQL["group_agg"], "total", "mean", "least", "most")
_text("text_topk", "SELECT ?o ?c (?v + 2*?b AS ?score) { ?o placed_by ?c ; total ?v . ?c balance ?b } ORDER BY DESC(?score) LIMIT 10", "SELECT concat('o', o_orderkey) AS o, concat('c', c_custkey) AS c, round(o_totalprice + 2 * c_acctbal, 2) AS score FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice + 2 * c_acctbal DESC, o, c LIMIT 10", "score")
_text("text_ask", "ASK { ?c segment MACHINERY ; in_nation n1 }", SQL["ask"])
_add("text_delete", lambda x: _per_predicate(text.run(x, "DELETE { ?c segment BUILDING } WHERE { ?c segment BUILDING }")), SQL["delete_where"])


def khop_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.reachable(fixture.vector_graph(spark, sf_dir), spark.createDataFrame([(3,), (17,)], "origin long"), 3)


def khop_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.reachable(fixture.vector_graph(spark, sf_dir), spark.createDataFrame([(3,)], "origin long"), 4, [URGENT, HIGH, LOW], True)


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(3, 17), (3, 42), (8, 99), (17, 3), (42, 42)], "a long, b long")


def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.shortest_length(fixture.vector_graph(spark, sf_dir), _pairs(spark), 6)


def cycle_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.on_cycle(fixture.vector_graph(spark, sf_dir), _pairs(spark).where("a <> b"), 6)


def _bfs(sources: str, steps: str, hops: int) -> str:
    return f"WITH RECURSIVE {GRAPH}, st AS ({steps}), b(origin, v, hops) AS (SELECT o, o, 0 FROM (VALUES {sources}) t(o) UNION SELECT b.origin, st.w, b.hops + 1 FROM b JOIN st ON st.v = b.v WHERE b.hops < {hops}), r AS (SELECT CAST(origin AS BIGINT) AS origin, CAST(v AS BIGINT) AS v, CAST(min(hops) AS INTEGER) AS hops FROM b GROUP BY origin, v)"


_UND, _DIR = "SELECT DISTINCT v, w FROM a", "SELECT DISTINCT src AS v, dst AS w FROM e"
QUERIES |= {"khop_reachable": khop_reachable, "khop_directed": khop_directed, "shortest_path_len": shortest_path_len, "cycle_exists": cycle_exists}
SQL |= {
    "khop_reachable": f"{_bfs('(3), (17)', _UND, 3)} SELECT * FROM r",
    "khop_directed": f"{_bfs('(3)', f'''{_DIR} WHERE rel IN ('{URGENT}', '{HIGH}', '{LOW}')''', 4)} SELECT * FROM r",
    "shortest_path_len": f"{_bfs('(3), (8), (17), (42)', _UND, 6)} SELECT CAST(p.a AS BIGINT) AS a, CAST(p.b AS BIGINT) AS b, r.hops AS length FROM (VALUES (3, 17), (3, 42), (8, 99), (17, 3), (42, 42)) p(a, b) LEFT JOIN r ON r.origin = p.a AND r.v = p.b",
    "cycle_exists": f"{_bfs('(3), (8), (17), (42), (99)', _DIR, 6)} SELECT CAST(p.a AS BIGINT) AS a, CAST(p.b AS BIGINT) AS b, x.hops IS NOT NULL AND y.hops IS NOT NULL AS cycle FROM (VALUES (3, 17), (3, 42), (8, 99), (17, 3)) p(a, b) LEFT JOIN r x ON x.origin = p.a AND x.v = p.b LEFT JOIN r y ON y.origin = p.b AND y.v = p.a",
}

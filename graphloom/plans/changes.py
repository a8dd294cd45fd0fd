"""Queries over updated triples, and nucleus numbers (cores, trusses, triangles), each with a plain SQL statement of the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cores, nuclei, updates
from graphloom.plans.matching import GRAPH
from graphloom.sources import fixture

#: Rounds that the SQL of core and truss numbers spells out.
ROUNDS = 40


def update_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = updates.modify(fixture.triple_graph(spark, sf_dir), [("?c", "segment", "?g"), ("?c", "in_nation", "n3")], [("?c", "segment", "?g")], [("?c", "in_market", "?g"), ("n3", "has_market", "?g")])
    return out.where(F.col("p").isin("segment", "in_market", "has_market"))


def update_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixture.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("s", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    entry = lambda df, seq, op, p, x: df.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "s", F.lit(p).alias("p"), F.col(x).alias("o"))
    log = entry(o, 1, "-", "priority", "o_orderpriority").unionByName(entry(o.where("o_totalprice > 100000"), 2, "+", "priority", "o_orderpriority"))
    log = log.unionByName(entry(o, 3, "+", "status", "o_orderstatus")).unionByName(entry(o, 4, "+", "status", "o_orderstatus"))
    return updates.replay(fixture.triple_graph(spark, sf_dir), log).where(F.col("p").isin("priority", "status"))


def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cores.core_numbers(fixture.vector_graph(spark, sf_dir))


def truss_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nuclei.truss_numbers(fixture.vector_graph(spark, sf_dir))


def triangle_nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nuclei.triangle_nuclei(fixture.vector_graph(spark, sf_dir))


def _nuclei_sql(parts: str, every: str, columns: str) -> str:
    """``parts``: (s, part) of the larger cliques; ``every``: the smaller ones by ``part``; ``columns``: what is returned."""
    worth = "SELECT x.part, min(h.est) AS est FROM m x JOIN m y ON x.s = y.s AND x.part <> y.part JOIN h{k} h ON h.part = y.part GROUP BY x.s, x.part"
    rounds = [f"h{k + 1} AS MATERIALIZED (SELECT part, max(least(est, r)) AS est FROM (SELECT part, est, row_number() OVER (PARTITION BY part ORDER BY est DESC) AS r FROM ({worth.format(k=k)})) GROUP BY part)" for k in range(ROUNDS)]
    edges = "d AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), t AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM d x JOIN d y ON x.b = y.a JOIN d z ON z.a = x.a AND z.b = y.b), q AS MATERIALIZED (SELECT t.*, x.b AS f FROM t JOIN d x ON x.a = t.c JOIN d y ON y.a = t.b AND y.b = x.b JOIN d z ON z.a = t.a AND z.b = x.b)"
    start = f"m AS MATERIALIZED ({parts}), h0 AS MATERIALIZED (SELECT part, count(*) AS est FROM m GROUP BY part)"
    return f"WITH {GRAPH}, {edges}, {start}, {', '.join(rounds)} SELECT {columns} FROM ({every}) LEFT JOIN h{ROUNDS} USING (part)"


def _cores_sql() -> str:
    rounds = [f"h{k + 1} AS MATERIALIZED (SELECT v, max(least(est, r)) AS est FROM (SELECT d.v, h{k}.est, row_number() OVER (PARTITION BY d.v ORDER BY h{k}.est DESC) AS r FROM d JOIN h{k} ON h{k}.v = d.w) GROUP BY v)" for k in range(ROUNDS)]
    start = "d AS MATERIALIZED (SELECT DISTINCT v, w FROM a WHERE v <> w), h0 AS MATERIALIZED (SELECT v, count(*) AS est FROM d GROUP BY v)"
    return f"WITH {GRAPH}, {start}, {', '.join(rounds)} SELECT CAST(vec_id AS BIGINT) AS v, CAST(coalesce(est, 0) AS BIGINT) AS core FROM embeddings LEFT JOIN h{ROUNDS} ON v = vec_id"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"update_modify": update_modify, "update_log": update_log, "core_numbers": core_numbers, "truss_numbers": truss_numbers, "triangle_nuclei": triangle_nuclei}
SQL = {
    "update_modify": "SELECT concat('c', c_custkey) AS s, CASE WHEN c_nationkey = 3 THEN 'in_market' ELSE 'segment' END AS p, c_mktsegment AS o FROM customer UNION ALL SELECT DISTINCT 'n3', 'has_market', c_mktsegment FROM customer WHERE c_nationkey = 3",
    "update_log": "SELECT concat('o', o_orderkey) AS s, 'priority' AS p, o_orderpriority AS o FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000 UNION ALL SELECT concat('o', o_orderkey), 'status', o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "core_numbers": _cores_sql(),
    "truss_numbers": _nuclei_sql("SELECT [a, b, c] AS s, unnest([[a, b], [a, c], [b, c]]) AS part FROM t", "SELECT *, [a, b] AS part FROM d", "a, b, CAST(coalesce(est, 0) + 2 AS BIGINT) AS truss"),
    "triangle_nuclei": _nuclei_sql("SELECT [a, b, c, f] AS s, unnest([[a, b, c], [a, b, f], [a, c, f], [b, c, f]]) AS part FROM q", "SELECT *, [a, b, c] AS part FROM t", "a, b, c, CAST(coalesce(est, 0) AS BIGINT) AS n"),
}

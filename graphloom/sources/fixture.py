"""Graphs over the driver's tables: vectors with relations from orders, and triples from foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes are the embeddings (types: the label, and 10 + id modulo 3); edges come from all orders."""
    emb = read(spark, sf_dir, "embeddings")
    n = emb.count()  # from the files' footers
    nodes = emb.select(F.col("vec_id").alias("v"), F.col("embedding").alias("emb"), F.array(F.col("label"), (10 + F.col("vec_id") % 3).cast("int")).alias("types"))
    o = read(spark, sf_dir, "orders")
    edges = o.select((F.col("o_custkey") % n).alias("src"), F.col("o_orderpriority").alias("rel"), ((F.col("o_orderkey") * 7 + 3) % n).alias("dst")).distinct()
    return Graph(nodes, edges.withColumn("edge_id", F.xxhash64("src", "rel", "dst")))


def vectors_of(spark: SparkSession, sf_dir: str, ids: dict[int, int]) -> dict[int, list[float]]:
    """Query vectors: the embeddings of a few ids (as many as pattern nodes)."""
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(sorted(set(ids.values())))).select("vec_id", "embedding").collect()
    at = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in rows}
    return {u: at[i] for u, i in ids.items()}


def triple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o): nations, regions, customers, suppliers and orders by their keys, with numeric literals."""
    t = lambda name: read(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def rows(df: DataFrame, s, p: str, o) -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    nation, region, customer, supplier, orders = (t(x) for x in ("nation", "region", "customer", "supplier", "orders"))
    parts = [
        rows(nation, key("n", "n_nationkey"), "in_region", key("r", "n_regionkey")),
        rows(nation, key("n", "n_nationkey"), "name", F.col("n_name")),
        rows(region, key("r", "r_regionkey"), "name", F.col("r_name")),
        rows(customer, key("c", "c_custkey"), "in_nation", key("n", "c_nationkey")),
        rows(customer, key("c", "c_custkey"), "balance", F.col("c_acctbal").cast("string")),
        rows(customer, key("c", "c_custkey"), "segment", F.col("c_mktsegment")),
        rows(supplier, key("s", "s_suppkey"), "in_nation", key("n", "s_nationkey")),
        rows(supplier, key("s", "s_suppkey"), "balance", F.col("s_acctbal").cast("string")),
        rows(orders, key("o", "o_orderkey"), "placed_by", key("c", "o_custkey")),
        rows(orders, key("o", "o_orderkey"), "total", F.col("o_totalprice").cast("string")),
        rows(orders, key("o", "o_orderkey"), "priority", F.col("o_orderpriority")),
    ]
    return reduce(DataFrame.unionByName, parts)

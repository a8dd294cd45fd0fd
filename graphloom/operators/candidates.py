"""Candidate sets: nearest neighbours, degree filters, inference along edges, refinement to a fixpoint.

A candidate table is (u, v, s): pattern node, graph node, distance. Every filter is a semi-join, so answers never change.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.operators.graph import Graph
from graphloom.operators.pattern import Pattern

#: Rounds of refinement for the filters that stop early; None goes on to the fixpoint.
ROUNDS = None


def distances(g: Graph, vectors: dict[int, list[float]], metric: str = "l2") -> DataFrame:
    """(u, v, s) of every node for every pattern node, in one scan; s is 0 for a pattern node without a vector."""
    each = F.array(*[F.struct(F.lit(u).alias("u"), (-vector.score(metric, F.col("emb"), q) if q is not None else F.lit(0.0)).alias("s")) for u, q in sorted(vectors.items())])
    return g.nodes.select("v", F.inline(each)).select("u", "v", "s")


def nearest(g: Graph, vectors: dict[int, list[float]], n: int, metric: str = "l2") -> DataFrame:
    """(u, v, s) of the n nearest nodes of each pattern node, ties to the smaller id; the limit is pushed below the sort."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("u").orderBy("s", "v"))
    return distances(g, vectors, metric).withColumn("r", rank).where(F.col("r") <= n).drop("r")


def degree_ok(g: Graph, p: Pattern, u: int) -> DataFrame:
    """(v) with at least the pattern node's degree (duplicate edges and self-loops count)."""
    return g.degrees().where(F.col("degree") >= p.degree(u)).select("v")


def relation_degree_ok(g: Graph, p: Pattern, u: int, directed: bool) -> DataFrame:
    """(v) that meet every relation's multiplicity of pattern node u."""
    need = p.requirements(u, directed)
    if not need:
        return g.nodes.select("v")
    rel = g.relation_degrees(directed)
    met = reduce(lambda a, b: a | b, [(F.col("way") == w) & (F.col("rel") == r) & (F.col("n") >= n) for (w, r), n in need.items()])
    return rel.where(met).groupBy("v").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") == len(need)).select("v")


def cover_candidates(g: Graph, p: Pattern, budget: int, directed: bool = False) -> dict[int, DataFrame]:
    """Candidates (v, s) of the cover nodes: the ``budget`` nearest first, then the degree filters. Nodes without a
    vector take all nodes."""
    out = {}
    cover = p.cover()
    near = nearest(g, {u: p.vectors[u] for u in cover if u in p.vectors}, budget) if any(u in p.vectors for u in cover) else None
    for u in cover:
        c = near.where(F.col("u") == u).select("v", "s") if u in p.vectors else g.nodes.select("v", F.lit(0.0).alias("s"))
        out[u] = c.join(degree_ok(g, p, u), "v", "left_semi").join(relation_degree_ok(g, p, u, directed), "v", "left_semi")
    return out


def supported(g: Graph, p: Pattern, u: int, cands: dict[int, DataFrame], directed: bool) -> DataFrame | None:
    """(v) that have, for every edge of u to a node with candidates, a neighbour among them; None without such edges."""
    found = None
    for a, r, b in p.proper:
        if u not in (a, b):
            continue
        w = b if a == u else a
        if w not in cands:
            continue
        near = g.steps(r, directed, a == u).join(cands[w].select(F.col("v").alias("nbr")), "nbr", "left_semi").select("v").distinct()
        found = near if found is None else found.join(near, "v", "left_semi")
    return found


def refine(g: Graph, p: Pattern, cands: dict[int, DataFrame], directed: bool = False, rounds: int | None = ROUNDS) -> dict[int, DataFrame]:
    """Arc consistency: infers nodes without candidates, then semi-joins every node with its neighbours until the
    number of candidates stays (or for ``rounds``). Each round is settled, so lineage stays short."""
    spark = g.nodes.sparkSession
    full = distances(g, {u: p.vectors.get(u) for u in range(p.nodes)})
    now, before = dict(cands), None
    for _ in itertools.count() if rounds is None else range(rounds):
        for u in range(p.nodes):
            ok = supported(g, p, u, now, directed)
            own = now.get(u)
            if ok is None:
                now[u] = own if own is not None else g.nodes.select("v", F.lit(0.0).alias("s")).limit(0)
            elif own is None:
                now[u] = full.where(F.col("u") == u).join(ok, "v", "left_semi").select("v", "s")
            else:
                now[u] = own.join(ok, "v", "left_semi")
        flat = keep(reduce(DataFrame.unionByName, [c.select(F.lit(u).alias("u"), "v", "s") for u, c in now.items()]), spark)
        now = {u: flat.where(F.col("u") == u).select("v", "s") for u in range(p.nodes)}
        sizes = {r["u"]: r["n"] for r in flat.groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pattern node
        if sizes == before or len(sizes) < p.nodes:
            break
        before = sizes
    return now


def keep(df: DataFrame, spark, placed: bool = False) -> DataFrame:
    """Cuts the lineage by a table in the shared folder (it comes from the session; our own only where unset).

    The rows are computed once, outlive lost executors, and their size is known to the planner. The file system removes
    the table when the application ends. ``placed``: by a reliable checkpoint instead, which keeps the partitioning for
    joins on it in every round.
    """
    where = _folder(spark)
    if placed:
        return df.checkpoint()
    path = f"{where}/graphloom_{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not where and held.isDefined():
        where = held.get()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="graphloom_")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def flat(cands: dict[int, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select(F.lit(u).alias("u"), "v", "s") for u, c in sorted(cands.items())])


def summary(cands: DataFrame, p: Pattern) -> DataFrame:
    """One row: candidates in all, mean, smallest and largest set, and those of cover and independent nodes."""
    cover = p.cover()
    per = cands.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.sum(F.when(F.col("u").isin(cover), F.col("n")).otherwise(0)).alias("cover"), F.sum(F.when(~F.col("u").isin(cover), F.col("n")).otherwise(0)).alias("independent"),
    )

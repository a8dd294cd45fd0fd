"""``python -m graphloom``: matches a file of patterns in a graph directory, or backs up and restores triples."""

from __future__ import annotations

import argparse
import json
import threading
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import match
from graphloom.operators.graph import Graph
from graphloom.sources import directories, versions
from graphloom.streaming.feed import pattern_of


def graph_of(spark: SparkSession, folder: str) -> Graph:
    tables = directories.load(spark, folder)
    types = tables["node_types"].groupBy("v").agg(F.sort_array(F.collect_set("type_id")).alias("types"))
    nodes = tables["nodes"].join(types, "v", "left").select("v", "emb", F.coalesce("types", F.array().cast("array<int>")).alias("types"))
    return Graph(nodes, tables["edges"])


def within(spark: SparkSession, seconds: float, name: str, made: Callable[[], DataFrame]) -> list | None:
    """The rows of what is made (at most k), or None where its jobs were cancelled as the time ran out; jobs of making it count too."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(name)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return made().collect()
    except (PySparkException, Py4JJavaError):  # a cancelled job comes as it is or wrapped
        if not late.is_set():
            raise
        return None
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def run_patterns(spark: SparkSession, graph: str, patterns: str, k: int, directed: bool, injective: bool, limit: float) -> list[dict]:
    """One result per line (a pattern as JSON) of the file, in its order; ``timeout`` marks those that ran out of time."""
    g, out = graph_of(spark, graph), []
    for number, row in enumerate(spark.read.text(patterns).where(F.trim("value") != "").collect()):
        p, began = pattern_of(row["value"]), time.time()
        rows = within(spark, limit, f"pattern-{number}", lambda p=p: match.top_k(g, p, k, directed, injective))
        found = [{"score": r["score"], "nodes": [r[f"v{u}"] for u in range(p.nodes)]} for r in rows or ()]
        out.append({"pattern": number, "timeout": rows is None, "seconds": round(time.time() - began, 3), "matches": found})
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    sub = parser.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match", help="the k best matches of each pattern, as JSON lines")
    m.add_argument("graph")
    m.add_argument("patterns")
    m.add_argument("-k", type=int, default=3)
    m.add_argument("--directed", action="store_true")
    m.add_argument("--homomorphic", action="store_true", help="nodes of a match may coincide")
    m.add_argument("--limit", type=float, default=3600, help="seconds for a pattern")
    b = sub.add_parser("backup", help="write N-Triples as a backup")
    b.add_argument("triples")
    b.add_argument("folder")
    b.add_argument("--seq", type=int, default=0)
    r = sub.add_parser("restore", help="write the triples after a log entry as Parquet")
    r.add_argument("folder")
    r.add_argument("out")
    r.add_argument("--seq", type=int)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "match":
        for line in run_patterns(spark, a.graph, a.patterns, a.k, a.directed, not a.homomorphic, a.limit):
            print(json.dumps(line))
    elif a.command == "backup":
        versions.backup(directories.parse_ntriples(spark.read.text(a.triples)), a.folder, a.seq)
    else:
        versions.restore(spark, a.folder, a.seq).write.parquet(a.out)


if __name__ == "__main__":
    main()

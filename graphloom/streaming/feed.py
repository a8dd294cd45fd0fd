"""A feed of patterns: each arriving micro-batch of (query_id, pattern as JSON) is matched and its results appended."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.match import top_k
from graphloom.operators.pattern import Pattern


def pattern_of(text: str) -> Pattern:
    d = json.loads(text)
    return Pattern(d["nodes"], tuple((a, r, b) for a, r, b in d["edges"]), {int(u): v for u, v in d.get("vectors", {}).items()})


def answer(g: Graph, batch: DataFrame, k: int) -> DataFrame | None:
    """(query_id, rank, score, nodes) of every pattern of a batch (patterns are few and small)."""
    from pyspark.sql import Window as W

    out = None
    for row in batch.select("query_id", "pattern").collect():
        p = pattern_of(row["pattern"])
        names = [f"v{u}" for u in range(p.nodes)]
        rows = top_k(g, p, k).select(F.lit(row["query_id"]).alias("query_id"), F.row_number().over(W.orderBy("score", *names)).alias("rank"), "score", F.array(*names).alias("nodes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def start(patterns: DataFrame, g: Graph, out: str, checkpoint: str, k: int = 3):
    """Starts the streaming query; every batch overwrites its own folder, so a batch that runs again leaves one copy."""

    def each(batch: DataFrame, number: int) -> None:
        rows = answer(g, batch, k)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return patterns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

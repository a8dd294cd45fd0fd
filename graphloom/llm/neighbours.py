"""Nearest neighbours by block matrix join: int8 product tiles, error bounds, float recomputation, heap merge.

Vectors are quantised once to int8 with a scale of their own; only the codes, scales and error norms go to the tiles. A tile of
query and candidate blocks multiplies the int8 matrices; since x = s q + e with a known norm of e, the product gives each distance
an interval: the distance of the quantised vectors, plus or minus both error norms. A pair survives if its lower end does
not exceed the k-th smallest upper end, first of its lane and then of all lanes. Survivors are joined with the original vectors,
recomputed in double precision, and merged by a heap of k entries for each query, so the result is exact; the int8 tiles only
decide what needs no recomputation.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
without an id; vectors of another dimension are no candidates of a query; ties go to the smaller id; repeated rows
are candidates each, but not of a query with their own id, and one of them is the query; extra columns are ignored; fewer candidates than k
give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import blocks, common

K = 10
EVERY = 100


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the errors) of the rows."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 rows (floats hold them exactly: see the bound)."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in doubles, summed in order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - y[:, j]) ** 2
    return np.sqrt(total)


def _code(x: np.ndarray) -> list[pa.Array]:
    codes, scale, error = quantised(x)
    return [blocks.raw(list(codes)), pa.array(scale), pa.array(error), blocks.raw(list(x))]


def _matrix(side: dict) -> dict:
    if "m" not in side:
        side["m"] = np.frombuffer(b"".join(side.pop("codes")), np.int8).reshape(-1, side["dim"])
        side["r"], side["id"], side["scale"], side["error"] = np.array(side["r"]), np.array(side["id"]), np.array(side["scale"]), np.array(side["error"])
        side["norm"] = (side["m"].astype(np.float32 if side["dim"] * 127 * 127 < 1 << 24 else np.float64) ** 2).sum(1).astype(np.float64) * side["scale"] ** 2
    return side


def _tile(k: int):
    """(q, r, low, high) of the pairs of a lane that may be among the k nearest: the ends of their distances' intervals."""

    def run(held: dict, block: dict) -> list:
        c, q = _matrix(held), _matrix(block)
        upper = np.full((len(q["id"]), k), np.inf)
        found = []
        for at in range(0, len(c["id"]), blocks.TILE):
            some = slice(at, at + blocks.TILE)
            square = q["norm"][:, None] + c["norm"][some] - 2 * product(q["m"], c["m"][some]) * (q["scale"][:, None] * c["scale"][some])
            size = np.sqrt(q["norm"])[:, None], np.sqrt(c["norm"][some])[None, :]
            slack = 1e-9 * (size[0] + size[1]) + 1e-7 * np.maximum(*size)
            near, off = np.sqrt(np.maximum(square, 0)), q["error"][:, None] + c["error"][some] + slack
            own = q["id"][:, None] == c["id"][some]
            high = np.where(own, np.inf, near + off)
            upper = np.partition(np.concatenate([upper, high], 1), k - 1, axis=1)[:, :k]
            rows, cols = np.nonzero((near - off <= upper.max(1)[:, None]) & ~own)
            found.append((rows, cols + at, (near - off)[rows, cols], high[rows, cols]))
        rows, cols, low, high = (np.concatenate(x) for x in zip(*found))
        on = low <= upper.max(1)[rows]
        return [q["r"][rows[on]], c["r"][cols[on]], low[on], high[on]]

    return run


def _heaps(k: int):
    """(query_id, vec_id, score): of every query, the k nearest pairs of a task by exact distance."""

    def run(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            q, v, x, y = (batch.column(i).to_pylist() for i in range(4))
            for dim in {len(z) for z in x}:
                at = [i for i, z in enumerate(x) if len(z) == dim]
                d = exact(*(np.frombuffer(b"".join(z[i] for i in at), np.float64).reshape(len(at), -1) for z in (x, y)))
                for i, score in zip(at, d.tolist()):
                    heap = heaps.setdefault(q[i], [])
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-score, -v[i]))  # the farthest, of ties the larger id, is on top
        rows = [(q, -v, -d) for q, heap in heaps.items() for d, v in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` to each row that ``queries`` holds for."""
    rows = blocks.numbered(vectors, queries, id_column, vector, False, _code, "codes binary, scale double, error double, v binary", ["codes", "scale", "error", "v"])
    asked = blocks.asked(rows)
    near = blocks.grid(rows, asked, ["codes", "scale", "error"], _tile(k), "q long, r long, low double, high double")
    limit = near.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("high"))).where(F.col("n") <= k).groupBy("q").agg(F.max("high").alias("limit"), F.count(F.lit(1)).alias("n"))
    left = near.join(limit, "q").where((F.col("low") <= F.col("limit")) | (F.col("n") < k)).select("q", "r")
    left = common.settle(left, "survivors").join(rows.select("r", F.col("id").alias("vec_id"), F.col("v").alias("y")), "r")
    left = left.join(asked.select(F.col("r").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("x")), "q").select("query_id", "vec_id", "x", "y")
    best = common.bounded(left).mapInArrow(_heaps(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op1_neighbours": op1_neighbours}
SQL = {
    "op1_neighbours": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), d AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
    """
}

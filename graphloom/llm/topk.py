"""Exact top-k inner products by the three-phase uniform threshold.

A vector's components are cut into PARTS slices; each slice keeps a score list of its own, the partial products.

1. Gather: every slice gives, for each query, its k largest partial scores, its smallest and its largest one. Scoring the objects
   seen so far with the smallest in place of what is missing gives a lower bound tau of the k-th best total.
   An object is one row, known by its number: rows of one id never add up to one object.
2. Cutoff: with low_s the smallest of slice s, an object whose partial score is below low_s + (tau - sum low) / PARTS
   in every slice totals less than tau. This cutoff goes out with the queries. The slices are then gone through in turn: an object
   whose known parts and the largest scores of the other slices total less than tau is dropped, before those are computed; what is
   left is a sufficient entry if a slice lists it at or above the cutoff.
3. Resolve: the missing parts of the entries are computed exactly, pair by pair, and the k best totals are merged.

Vectors are the integers floor(256 x); sums of products are exact (doubles up to 2^53, else 64-bit integers).

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without
an id; zero vectors do; vectors of another dimension are no candidates; ties go to the smaller id; repeated rows are
candidates each, and one of them is the query; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import blocks, common

K, EVERY, PARTS, SCALE = 5, 50, 2, 256
#: Pairs whose missing parts are computed at once, one by one; where more than one of DENSE pairs is left, a whole product is faster.
PIECE, DENSE = 1 << 16, 32

_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def whole(x: np.ndarray) -> np.ndarray:
    """The integer vectors, as doubles."""
    return np.floor(SCALE * x)


def slices(dim: int, parts: int = PARTS) -> list[slice]:
    edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _small(x: np.ndarray, y: np.ndarray) -> bool:
    return not x.size or not y.size or float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2.0**53


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    return (x @ y.T).astype(np.int64) if _small(x, y) else x.astype(np.int64) @ y.astype(np.int64).T


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows with their like."""
    return (x * y).sum(1).astype(np.int64) if _small(x, y) else (x.astype(np.int64) * y.astype(np.int64)).sum(1)


def _code(x: np.ndarray) -> list[pa.Array]:
    """Rows of 16-bit integers where they fit, else of doubles."""
    n = whole(x)
    return [blocks.raw([v.astype(np.int16) if np.abs(v).max() < 1 << 15 else v for v in n])]


def _matrix(side: dict) -> np.ndarray:
    if "m" not in side:
        dim, code = side["dim"], side.pop("code")
        short = [len(x) == 2 * dim for x in code]
        if all(short):
            side["m"] = np.frombuffer(b"".join(code), np.int16).reshape(-1, dim)
        else:
            side["m"] = np.stack([np.frombuffer(x, np.int16 if s else np.float64).astype(np.float64) for x, s in zip(code, short)])
        side["r"], side["id"] = np.array(side["r"]), np.array(side["id"])
    return side["m"]


def _tiles(held: dict, block: dict):
    """(queries, first candidate, candidates, where a candidate is the query's own row or id) of each tile."""
    y, x = _matrix(held), _matrix(block).astype(np.float64)
    for at in range(0, len(y), blocks.TILE):
        some = slice(at, at + blocks.TILE)
        yield x, at, y[some].astype(np.float64), block["id"][:, None] == held["id"][some]


def _keep(k: int, score: np.ndarray, out: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Row-wise the k largest scores that are not ``out``, ties to smaller entries of the first column; missing ones are _NONE."""
    order = np.lexsort((np.broadcast_to(columns[0], score.shape), ~score, out), axis=1)[:, :k]  # ~ turns the order of integers without overflow
    found = [np.where(np.take_along_axis(out, order, 1), _NONE, np.take_along_axis(score, order, 1))]
    found += [np.take_along_axis(np.broadcast_to(c, score.shape), order, 1) for c in columns]
    if found[0].shape[1] < k:
        found = [np.pad(x, ((0, 0), (0, k - x.shape[1])), constant_values=_NONE) for x in found]
    return found


def _gather(k: int):
    def run(held: dict, block: dict) -> list:
        n, parts = len(block["id"]), slices(block["dim"])
        low, high = np.full((n, len(parts)), _LAST), np.full((n, len(parts)), _NONE)
        best: list = [None] * len(parts)
        for x, at, y, own in _tiles(held, block):
            for s, part in enumerate(parts):
                p = product(x[:, part], y[:, part])
                low[:, s] = np.minimum(low[:, s], np.where(own, _LAST, p).min(1))
                high[:, s] = np.maximum(high[:, s], np.where(own, _NONE, p).max(1))
                kth = np.partition(np.where(own, _NONE, p), max(0, p.shape[1] - k), axis=1)[:, max(0, p.shape[1] - k)]
                some = np.flatnonzero((p >= kth[:, None]).any(0))  # of these columns come all k largest
                found = _keep(k, p[:, some], own[:, some], held["r"][at + some][None, :])
                if best[s] is not None:
                    both = [np.concatenate(z, 1) for z in zip(best[s], found)]
                    found = _keep(k, both[0], both[0] == _NONE, both[1])
                best[s] = found
        rows = [(q, s, low[i, s], high[i, s], best[s][0][i].tolist(), best[s][1][i].tolist()) for i, q in enumerate(block["r"]) for s in range(len(parts))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]

    return run


def cutoffs(lists: DataFrame, k: int) -> DataFrame:
    """(q, tau, lows, highs): from every lane's local lists, the safe cutoff of each query."""
    ends = lists.groupBy("q", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = common.settle(ends.where("low <= high"), "ends")
    total = ends.groupBy("q").agg(F.sum("low").alias("low_sum"), F.array_sort(F.collect_list(F.struct("part", "low", "high"))).alias("parts"))
    seen = lists.select("q", "part", F.explode(F.arrays_zip("best", "rows")).alias("e")).where(F.col("e.best") != _NONE).select("q", "part", F.col("e.rows").alias("row"), F.col("e.best").alias("p"))
    top = seen.withColumn("n", F.row_number().over(W.partitionBy("q", "part").orderBy(F.desc("p"), "row"))).where(F.col("n") <= k)
    over = top.join(ends, ["q", "part"]).groupBy("q", "row").agg(F.sum(F.col("p") - F.col("low")).alias("gain"))
    kth = over.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("gain"), "row"))).where(F.col("n") == k).select("q", "gain")
    each = lambda name: F.transform("parts", lambda x: x[name]).alias(f"{name}s")
    # with fewer than k objects seen there is no k-th total: the sum of the smallest is a bound of all
    return common.settle(total.join(kth, "q", "left").select("q", (F.col("low_sum") + F.coalesce("gain", F.lit(0))).alias("tau"), each("low"), each("high")), "cutoffs")


def _resolve(k: int):
    def run(held: dict, block: dict) -> list:
        n, parts = len(block["id"]), slices(block["dim"])
        known = [i for i, t in enumerate(block["tau"]) if t is not None]  # a query without candidates has none
        tau = np.full(n, _LAST)
        low, high = np.zeros((n, len(parts)), np.int64), np.zeros((n, len(parts)), np.int64)
        for i in known:
            tau[i], low[i], high[i] = block["tau"][i], block["lows"][i], block["highs"][i]
        cut = low + (-(-(tau - low.sum(1)) // len(parts)))[:, None]  # the ceiling: partial scores are integers
        best, ids = np.full((n, k), _NONE), np.full((n, k), _LAST)
        for x, at, y, own in _tiles(held, block):
            first = product(x[:, parts[0]], y[:, parts[0]])
            need = np.maximum(tau, best[:, -1])
            rows, cols = np.nonzero((first + high[:, 1:].sum(1)[:, None] >= need[:, None]) & ~own)
            total, listed = first[rows, cols], first[rows, cols] >= cut[rows, 0]
            for s in range(1, len(parts)):
                part = parts[s]
                if len(rows) * DENSE > first.size:
                    mine = product(x[:, part], y[:, part])[rows, cols]
                else:
                    mine = np.concatenate([paired(x[rows[i : i + PIECE], part], y[cols[i : i + PIECE], part]) for i in range(0, len(rows), PIECE)] or [np.zeros(0, np.int64)])
                total, listed = total + mine, listed | (mine >= cut[rows, s])
                on = total + high[rows, s + 1 :].sum(1) >= need[rows]
                rows, cols, total, listed = rows[on], cols[on], total[on], listed[on]
            on = listed & (total >= need[rows])
            rows, total, found = rows[on], total[on], held["id"][at + cols[on]]
            all_rows = np.concatenate([rows, np.repeat(np.arange(n), k)])
            all_s, all_id = np.concatenate([total, best.ravel()]), np.concatenate([found, ids.ravel()])
            order = np.lexsort((all_id, ~all_s, all_rows))
            start = np.searchsorted(all_rows[order], np.arange(n))
            take = order[(start[:, None] + np.arange(k)).ravel()]
            best, ids = all_s[take].reshape(-1, k), all_id[take].reshape(-1, k)
        some = (ids != _LAST).ravel() | (best != _NONE).ravel()
        return [np.repeat(block["id"], k)[some], ids.ravel()[some], best.ravel()[some]]

    return run


def search(vectors: DataFrame, queries: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product with each query row."""
    rows = blocks.numbered(vectors, queries, id_column, vector, True, _code, "code binary", ["code"])
    asked = blocks.asked(rows)
    lists = blocks.grid(rows, asked, ["code"], _gather(k), "q long, part int, low long, high long, best array<long>, rows array<long>")
    cut = cutoffs(lists, k)
    ready = common.settle(asked.join(cut.withColumnRenamed("q", "r"), "r", "left"), "queries")
    best = blocks.grid(rows, ready, ["code"], _resolve(k), "query_id long, vec_id long, score long", ["tau", "lows", "highs"])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op10_topk": op10_topk}
SQL = {
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), d AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 5
    """
}

"""A grid of candidate lanes and query blocks: a stated query set meets all rows, block by block.

Candidate vectors are dealt to lanes once and held there, in their compact form; the query vectors go to every lane and stream
by. So what is sent grows with the candidates plus the queries times the lanes, a task holds no more than its lane (about HELD
vectors) and one query block, and it gives a few rows of each query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common

#: Candidate vectors of a lane at most, about, and at least, where there are so many; queries of a block; candidates of a tile.
HELD, LEAST, QUERIES_ROWS, TILE = 1 << 18, 4096, 512, 4096


def usable(column: pa.ListArray, zero: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """(row numbers, dims, views) of vectors that are not null and hold only finite components (``zero``: zero ones too)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    rows, views = [], []
    for i in np.flatnonzero(valid):
        v = values[offsets[i] : offsets[i + 1]]
        if len(v) and np.isfinite(v).all() and (zero or v.any()):
            rows.append(i)
            views.append(v)
    return np.array(rows, np.int64), np.array([len(v) for v in views], np.int64), views


def numbered(vectors: DataFrame, queries: Column, id_column: str, vector: str, zero: bool, code: Callable, fields: str, names: list[str]) -> DataFrame:
    """(r, id, dim, is_query, ...) of every usable row: r is its number, ``code(matrix)`` gives the columns of its compact form."""

    def run(batches):
        r = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, dims, views = usable(batch.column(1), zero)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                mine = [k for k in np.flatnonzero(dims == dim) if known[at[k]]]
                if mine:
                    rows = pa.array(at[mine])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(r, r + len(mine))), batch.column(0).take(rows), pa.array(np.full(len(mine), dim)), batch.column(2).take(rows), *code(np.stack([views[k] for k in mine]))],
                        ["r", "id", "dim", "is_query", *names],
                    )
                    r += len(mine)

    both = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    return common.settle(both.mapInArrow(run, f"r long, id long, dim long, is_query boolean, {fields}"), "vectors")


def asked(rows: DataFrame) -> DataFrame:
    """The rows that are queries: of several with one id, the first."""
    first = rows.where("is_query").groupBy("id").agg(F.min("r").alias("r"))
    return common.settle(rows.join(first.select("r"), "r", "left_semi"), "queries")


def raw(rows: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([x if isinstance(x, bytes) else x.tobytes() for x in rows], pa.binary())


def lanes(rows: DataFrame) -> int:
    """As many as the session's partitions, but no smaller than LEAST nor larger than HELD: every lane gives a few rows of each query."""
    n = rows.count()
    return max(1, min(common.partitions(rows), -(-n // LEAST)), -(-n // HELD))


def grid(rows: DataFrame, queries: DataFrame, columns: list[str], run: Callable, schema: str, extra: list[str] | None = None) -> DataFrame:
    """``run(held, block)`` for every lane and query block of one dimension: both are dicts of arrays and lists by column (``held`` keeps
    what ``run`` puts there); it gives Arrow columns of ``schema``. ``extra`` columns are the queries' own."""
    extra = extra or []
    n = lanes(rows)
    kept = ["r", "id", *columns]
    types = {**dict(queries.dtypes)}
    c = rows.select("dim", F.pmod(F.xxhash64("r"), F.lit(n)).cast("int").alias("lane"), F.lit(0).alias("kind"), *kept, *[F.lit(None).cast(types[x]).alias(x) for x in extra])
    q = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("lane"), F.lit(1).alias("kind"), *kept, *extra)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def task(batches):
        now, held, block, size = None, None, None, 0

        def fresh():
            return {x: [] for x in kept + extra}

        def tell():
            columns = run(held, block) if len(held["id"]) and len(block["id"]) else None
            return [pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)] if columns and len(columns[0]) else []

        for batch in batches:
            for dim, lane, kind, *values in zip(*(x.to_pylist() for x in batch.columns)):
                if (dim, lane) != now:
                    if now is not None:
                        yield from tell()
                    now, held, block = (dim, lane), fresh() | {"dim": dim}, fresh() | {"dim": dim}
                if kind == 1 and len(block["id"]) == QUERIES_ROWS:
                    yield from tell()
                    block = fresh() | {"dim": dim}
                to = block if kind else held
                for x, value in zip(kept + extra, values):
                    to[x].append(value)
        if now is not None:
            yield from tell()

    dealt = common.bounded(c.unionByName(q)).repartition(n, "dim", "lane").sortWithinPartitions("dim", "lane", "kind")
    return common.settle(dealt.mapInArrow(task, schema), "grid")



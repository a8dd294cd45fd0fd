"""Helpers shared by the training-data operators: tables in the shared folder, text buffers, hashes.

Text kernels never decode strings: an Arrow text column is one UTF-8 byte buffer with offsets, so words,
shingles and subwords are found and hashed with whole-array numpy operations. Buffers are cut to
``CHUNK_CHARS`` bytes (one longer document stands alone), which bounds a worker's memory.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on.
CHUNK_CHARS = 1 << 19
#: Rows and bytes of an Arrow batch, and rows of a Parquet reader's batch, at most: what tasks hold of whole texts at once.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 2048, 1 << 23, 512

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a folder of our own where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark, "_graphloom_shared", None) or tempfile.mkdtemp(prefix="graphloom_")
        spark._graphloom_shared = folder
    return folder.rstrip("/")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage, survives lost executors, and lets adaptive execution split skewed joins on it. The
    file system removes the table when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What workers remember from task to task, by owner.
REMEMBERED: dict[str, dict] = {}


def kernel(run: Callable, owner: str = "") -> Callable:
    """``run`` for mapInArrow, with a worker that gives its memory back: what other operators remember is dropped before,
    and freed memory is returned to the system after each task."""

    def task(batches):
        # imported here: a global of a function that is sent to a worker arrives as a copy, not as this module's own
        from graphloom.llm import common

        for name in [k for k in common.REMEMBERED if k != owner]:
            del common.REMEMBERED[name]
        try:
            yield from run(batches)
        finally:
            common._powers[:] = [np.ones(1, _U), np.ones(1, _U)]
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def bounded(df: DataFrame) -> DataFrame:
    """``df``, read and sent to workers in batches of few rows: batches of whole texts are what tasks hold at once."""
    conf = df.sparkSession.conf
    for key, most in (("execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("parquet.columnarReaderBatchSize", READ_ROWS)):
        now = conf.get(f"spark.sql.{key}", str(most + 1))  # one with a unit is the user's and stays
        if now.isdecimal() and int(now) > most:
            conf.set(f"spark.sql.{key}", most)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions: what keyed work here is dealt over."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def column_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (inputs may carry clashing extra columns)."""
    while name in df.columns:
        name = f"_{name}"
    return name


# ------------------------------------------------------------------------------------------------ buffers


def large(column: pa.Array) -> pa.Array:
    """The text column as large_string, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, len(column))
        at = to


def buffer(column: pa.Array, end: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string slice in which every text is followed by ``end``."""
    joined = pc.binary_join_element_wise(column.cast(pa.large_binary()), pa.scalar(end, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


# ------------------------------------------------------------------------------------------------- hashes

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, _MULT_INV)):
            out = np.full(size, base, _U)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (as in splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] (modulo 2^64) the positional hash of data[i:j]; see span_hash."""
    pw, _ = powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * pw, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal bytes give equal hashes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the document of each."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # every text ends in white space: starts and ends alternate
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U, copy=False).view(np.int64)


def crc_fold(column, mod: int):
    """crc32(text of the id) modulo ``mod``, as a column expression."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata, in bins.

A document is a sparse vector x: its words hashed to buckets (counts on unit length), one indicator per structure
statistic (share of capitals, symbols, digits, table bars, repeated lines, stuttered words, word and line lengths, size) for the bin
it falls in, and one for the bin of its metadata (n_chars, by its logarithm, or none). The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

the pairwise interactions of rank RANK in time linear in the words. Trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows. Labels, lang, source and doc_id are never inputs.

Defined results: null and empty texts are scored by their structure alone; without training rows every score is 0.5;
repeated rows score alike; of repeated labels of one document the largest counts once per row; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

FOLDS, HELD = 3, 1
BUCKETS, BINS, RANK = 1 << 16, 12, 8
#: At most so many labelled rows are learned from (smallest hashes of the id), by their whole texts, which executors make features of.
SAMPLE = 6000
EPOCHS, RATE, BATCH, DECAY = 8, 0.15, 32, 1e-5

_U = np.uint64
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'"]] = True
#: Structure statistics, and the metadata after them.
STATS = 11


@dataclass
class Model:
    w0: float
    w: np.ndarray  # (BUCKETS + STATS * BINS)
    v: np.ndarray  # (BUCKETS + STATS * BINS) x RANK


def statistics(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, word: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """documents x STATS bins; ``chars`` is n_chars, or -1 where it is not known."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets) - 1, 1).astype(float)

    def share(flag: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flag)])
        return np.diff(run[offsets]) / size

    words = np.maximum(np.bincount(doc, minlength=n), 1)
    length = np.bincount(doc, (end - start), minlength=n) / words
    capital = np.bincount(doc, _UPPER[data[start]], minlength=n) / words
    stutter = np.bincount(doc[1:], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1]), minlength=n) / words
    lines = share(data == 10) * size
    last = np.bincount(doc, _SYMBOL[data[end - 1]], minlength=n) / words
    newline = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], newline[:-1] + 1]) if len(newline) else newline
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    line_hash = common.span_hash(common.prefix_hash(data), begin, newline)
    _, first = np.unique(np.stack([line_doc.astype(_U), line_hash]), axis=1, return_index=True) if len(begin) else (None, np.zeros(0, int))
    distinct = np.bincount(line_doc[first], minlength=n)
    repeated = 1 - distinct / np.maximum(lines, 1)
    log = lambda x, a: np.clip(np.log1p(x) / a, 0, 0.999)
    values = [share(_UPPER[data]), np.minimum(share(_SYMBOL[data]) * 4, 0.999), np.minimum(share(_DIGIT[data]) * 4, 0.999), np.minimum(share(data == 124) * 8, 0.999), repeated, np.clip(length / 24, 0, 0.999), capital, last, stutter, log(np.bincount(doc, minlength=n), 10)]
    values.append(np.where(chars < 0, 0, 0.1 + 0.9 * log(np.maximum(chars, 0), 13)))
    return np.stack([np.clip(np.ceil(x * (BINS - 1)), 0, BINS - 1).astype(np.int64) for x in values], 1)


def vectors(column: pa.Array, chars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a large_string slice and its metadata: (row, feature, value), by row."""
    data, offsets = common.buffer(column)
    n = len(column)
    chars = np.full(n, -1) if chars is None else chars
    start, end, doc = common.words(data, offsets)
    word = common.span_hash(common.prefix_hash(common.lower(data)), start, end)
    key, count = np.unique((doc.astype(_U) << _U(32)) | (word & _U(BUCKETS - 1)), return_counts=True)
    row = (key >> _U(32)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, minlength=n))
    bins = statistics(data, offsets, start, end, doc, word, chars) + BUCKETS + np.arange(STATS) * BINS
    rows = np.concatenate([row, np.repeat(np.arange(n), STATS)])
    feature = np.concatenate([(key & _U(0xFFFFFFFF)).astype(np.int64), bins.ravel()])
    value = np.concatenate([count / norm[row], np.full(n * STATS, 1.0 / 3)])
    order = np.argsort(rows, kind="stable")
    return rows[order].astype(np.int32), feature[order].astype(np.int32), value[order].astype(np.float32)


def score(model: Model, column: pa.Array, chars: np.ndarray | None = None) -> np.ndarray:
    row, feature, x = vectors(column, chars)
    at = np.searchsorted(row, np.arange(len(column)))  # every row has its structure features
    linear = np.add.reduceat(model.w[feature] * x, at)
    vx = model.v[feature] * x[:, None]
    pairs = (np.add.reduceat(vx, at, axis=0) ** 2 - np.add.reduceat(vx**2, at, axis=0)).sum(1) / 2
    return 1 / (1 + np.exp(-np.clip(model.w0 + linear + pairs, -30, 30)))


def train(texts: list[str], labels: list[int], chars: list[int] | None = None) -> Model:
    """The model fitted to texts held here."""
    column, rows = pa.array(texts, pa.large_string()), []
    chars = np.full(len(texts), -1) if chars is None else np.array(chars)
    for a, b in common.slices(column):
        r, f, v = vectors(column.slice(a, b - a), chars[a:b])
        edge = np.searchsorted(r, np.arange(b - a + 1))
        rows += [(f[i:j], v[i:j]) for i, j in zip(edge, edge[1:])]
    return fit(rows, labels)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 0) -> Model:
    """The model fitted to (features, values) of each row."""
    size = BUCKETS + STATS * BINS
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.01, (size, RANK)))
    if not rows:
        model.v[:] = 0
        return model
    y = np.array(labels, float)
    feature, x = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    gw, gv = np.full(size, 1e-3), np.full((size, RANK), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            idx = np.concatenate([np.arange(at[i], at[i + 1]) for i in some])
            f, v = feature[idx], x[idx]
            starts = np.concatenate([[0], np.cumsum(at[some + 1] - at[some])[:-1]])
            of = np.repeat(np.arange(len(some)), at[some + 1] - at[some])
            vx = model.v[f] * v[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = model.w0 + np.add.reduceat(model.w[f] * v, starts) + (total**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(1) / 2
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            model.w0 -= RATE * d.sum()
            near, back = np.unique(f, return_inverse=True)
            grad = np.bincount(back, d[of] * v) + DECAY * model.w[near]
            gw[near] += grad**2
            model.w[near] -= RATE * grad / np.sqrt(gw[near])
            each = d[of][:, None] * v[:, None] * (total[of] - vx)
            gradv = np.stack([np.bincount(back, each[:, j]) for j in range(RANK)], 1) + DECAY * model.v[near]
            gv[near] += gradv**2
            model.v[near] -= 0.3 * RATE * gradv / np.sqrt(gv[near])
    return model


def _chars(docs: DataFrame):
    """The metadata column, -1 where there is none."""
    return F.coalesce(F.expr("try_cast(n_chars AS BIGINT)"), F.lit(-1)) if "n_chars" in docs.columns else F.lit(-1).cast("long")


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """(features, values) and labels of at most SAMPLE labelled rows out of the held-out fold; whole texts become features on the executors."""
    chosen = (
        labels.select("doc_id", "quality")
        .where((common.crc_fold("doc_id", FOLDS) != HELD) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )

    def run(batches):
        for batch in batches:
            text, chars = common.large(batch.column(1)), batch.column(2).to_numpy()
            for a, b in common.slices(text):
                row, feature, value = vectors(text.slice(a, b - a), chars[a:b])
                edge = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (feature, value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists, batch.column(3).slice(a, b - a)], ["doc_id", "features", "x", "quality"])

    rows = common.bounded(docs).select("doc_id", "text", _chars(docs).alias("chars")).join(F.broadcast(chosen), "doc_id")
    made = rows.mapInArrow(common.kernel(run), "doc_id long, features array<int>, x array<float>, quality int")
    found = made.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features", "x")).limit(SAMPLE).toArrow()
    sparse = lambda name: [v.values.to_numpy() for v in found.column(name)]
    return list(zip(sparse("features"), sparse("x"))), found.column("quality").to_pylist()


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            text, chars = common.large(batch.column(1)), batch.column(3).to_numpy()
            p = np.concatenate([score(m, text.slice(a, b - a), chars[a:b]) for a, b in common.slices(text)]) if len(text) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = common.bounded(docs).select("doc_id", "text", (common.crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), _chars(docs).alias("chars"))
    return rows.mapInArrow(common.kernel(run), "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return classify(docs, fit(*training_rows(docs, common.table(spark, sf_dir, "labels"))))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}

"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's vector is the mean of the embeddings of its subwords (byte n-grams inside words, hashed to a fixed
number of rows); a linear softmax over it gives the language. Both factors are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. Because the mean and the linear layer commute, scoring
uses their product, one row of class scores per hash row: the same function at a few gathers per byte.

Rejection: scores are scaled by a temperature, and the threshold is the score (as log odds, since probabilities near 1
round to 1) below which wrong outweighs right: it
loses the least of the held-back rows predicted right plus of the wrong ones (a share of each), and none of those predicted right. Wrong are held-back rows
predicted wrong, letter junk, and held-back rows of a language left out of a training of its own. A rejected text
keeps its best language in ``lang_pred`` with ``rejected`` set.

Defined results: a null text, or one with no letter, gives ``und`` with score 0 and is rejected; with no labelled
row to learn from every text is ``und``. Repeated rows are scored alike; ties go to the alphabetically first
language; extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import common

UND = "und"
FOLDS, HELD = 5, 0
#: Rows of the embedding table, its width, and the byte lengths of subwords.
ROWS, WIDTH, GRAMS = 1 << 16, 8, (2, 3, 4)
#: At most so many labelled rows are learned from, by their whole texts: of each language those with the smallest hashes of the id, its
#: share of the rows but LEAST of them at least.
SAMPLE, LEAST = 4000, 50
#: Subwords of a row that a step of the descent draws (evenly from the whole text), about.
DRAWN = 2000
EPOCHS, RATE, BATCH = 6, 2.0, 32
#: Steps of gradient descent at least: few rows are gone over more often.
STEPS = 600
#: So many languages (those with the most rows) are left out in turn, in trainings of so many steps, and so many held-back
#: rows of each, and of letter junk, are scored as wrong ones.
LEFT_OUT, LEFT_OUT_STEPS, WRONG = 4, 150, 200
#: How far below all held-back rows that are right the threshold stays, as a share of the way to their middle.
MARGIN = 0.03

_U = np.uint64


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # ROWS x languages: embeddings times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float  # of log odds


def subwords(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, hash row) of each n-gram of lower-cased bytes with no white space but at its first byte."""
    if len(data) < max(GRAMS):
        data = np.concatenate([data, np.full(max(GRAMS) - len(data), 32, np.uint8)])
    low = common.lower(data)
    space = common._SPACE[low]
    low = np.where(space, np.uint8(32), low).astype(np.uint32)
    open_ = np.ones(len(low) - 1, bool)
    code = low.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[: len(low) - n + 1] * np.uint32(257) + low[n - 1 :]
        open_ = open_[: len(low) - n + 1] & ~space[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(open_)
            h = code[at] * np.uint32(2654435761) + np.uint32(n)
            yield at, ((h ^ (h >> np.uint32(15))) & np.uint32(ROWS - 1)).astype(np.int64)


def score(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(best language's number, its probability) of each text of a large_string slice."""
    best, value = odds(model, column)
    return best, probability(value)


def probability(value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(value, -700, 700)))


def odds(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(best language's number, the log odds of it) of each text of a large_string slice."""
    data, offsets = common.buffer(column)
    n, classes = len(column), len(model.languages)
    total, count = np.zeros((n, classes)), np.zeros(n)
    for at, row in subwords(data):
        bounds = np.searchsorted(at, offsets)
        count += np.diff(bounds)
        for k in range(classes):
            run = np.concatenate([[0.0], np.cumsum(model.table[row, k])])
            total[:, k] += np.diff(run[bounds])
    z = (total / np.maximum(count, 1)[:, None] + model.bias) * model.temperature
    best = z.argmax(1)
    top = z[np.arange(n), best]
    z[np.arange(n), best] = -np.inf
    next_ = z.max(1, initial=-700.0)
    return best, top - next_ - np.log(np.exp(z - next_[:, None]).sum(1).clip(1e-300))


def train(texts: list[str], languages: list[str], seed: int = 0) -> Model | None:
    """Fits the embeddings and the softmax; every fifth row is held back to calibrate."""
    names = sorted(set(languages))
    if not names:
        return None
    y = np.searchsorted(names, languages)
    bags = []
    for text in texts:
        bag = np.concatenate([row for _, row in subwords(np.frombuffer(text.encode() + b"\n", np.uint8))]).astype(np.int32)
        # a long text's mean is estimated from subwords of all of it, in a random order that steps go through in turn
        bags.append(bag[np.random.default_rng(len(bag)).permutation(len(bag))] if len(bag) > DRAWN else bag)
    rng = np.random.default_rng(seed)
    held = np.arange(len(bags)) % 5 == 4
    learn = np.flatnonzero(~held)
    learn = learn[[len(bags[i]) > 0 for i in learn]] if len(learn) else learn
    epochs = max(EPOCHS, -(-STEPS // (len(learn) // BATCH + 1)))
    model = Model(names, *_fit(bags, y, len(names), learn, epochs, rng), 1.0, -np.inf)
    if held.any():
        column = pa.array([texts[i] for i in np.flatnonzero(held)], pa.large_string())
        best, grid = None, []
        for t in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
            model.temperature = t
            got, value = odds(model, column)
            right, p = got == y[held], probability(value)
            grid.append((-np.log(np.clip(np.where(right, p, (1 - p) / max(1, len(names) - 1)), 1e-9, 1)).mean(), t, value[right], value[~right]))
        best = min(grid, key=lambda g: g[0])
        model.temperature = best[1]
        model.threshold = cutoff(best[2], np.concatenate([best[3], *_wrong(model, texts, bags, y, held, learn, rng)]))
    return model


def _fit(bags: list[np.ndarray], y: np.ndarray, classes: int, learn: np.ndarray, epochs: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) fitted to the rows ``learn``."""
    emb = rng.uniform(-1, 1, (ROWS, WIDTH)) / WIDTH
    out, bias = np.zeros((WIDTH, classes)), np.zeros(classes)
    steps, step = epochs * (len(learn) // BATCH + 1), 0
    for _ in range(epochs if len(learn) else 0):
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            drawn = [bags[i] if len(bags[i]) <= DRAWN else np.take(bags[i], np.arange(step * DRAWN, (step + 1) * DRAWN), mode="wrap") for i in rows]
            flat = np.concatenate(drawn)
            size = np.array([len(x) for x in drawn])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            mean = np.add.reduceat(emb[flat], starts, axis=0) / size[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            grad = np.clip(p @ out.T, -1, 1)  # texts of few subwords would run away otherwise
            out = np.clip(out - rate * mean.T @ p / len(rows) * 4, -20, 20)
            bias -= rate * p.mean(0)
            np.add.at(emb, flat, np.repeat(-rate * 8 * grad / size[:, None], size, axis=0))
    return emb @ out, bias


def junk(texts: list[str], rng) -> list[str]:
    """Texts that are no language: of each, words of letters drawn alike, or its own letters in another order."""
    out = []
    for k, text in enumerate(texts):
        letters = list(text)
        draw = np.array([chr(97 + c) for c in range(26)] if k % 2 else [c for c in letters if c.isalpha()] or ["x"])
        out.append("".join(c if c.isspace() else str(d) for c, d in zip(letters, rng.choice(draw, len(letters)))))
    return out


def _wrong(model: Model, texts: list[str], bags: list[np.ndarray], y: np.ndarray, held: np.ndarray, learn: np.ndarray, rng) -> list[np.ndarray]:
    """Log odds of examples that are wrong whatever is predicted: letter junk, and languages left out of the training."""
    found = np.flatnonzero(held)[: 2 * WRONG]
    scores = [odds(model, pa.array(junk([texts[i] for i in found], rng), pa.large_string()))[1]]
    n = len(model.languages)
    for left in np.argsort(-np.bincount(y, minlength=n), kind="stable")[:LEFT_OUT] if n > 2 else []:
        out = np.flatnonzero(held & (y == left))[:WRONG]
        kept = learn[y[learn] != left]
        if len(out) and len(kept):
            epochs = -(-LEFT_OUT_STEPS // (len(kept) // BATCH + 1))
            table, bias = _fit(bags, y - (y > left), n - 1, kept, epochs, rng)
            other = Model([x for k, x in enumerate(model.languages) if k != left], table, bias, model.temperature, -np.inf)
            scores.append(odds(other, pa.array([texts[i] for i in out], pa.large_string()))[1])
    return scores


def cutoff(right: np.ndarray, wrong: np.ndarray) -> float:
    """The smallest score that loses the least: the share of ``right`` below it and of ``wrong`` at or above it. It stays below all of
    ``right`` by MARGIN of the way from their middle to their least, so that clean texts not seen here are kept too."""
    if not len(right) or not len(wrong):
        return -np.inf
    most = right.min() - MARGIN * (np.median(right) - right.min())
    at = np.unique(np.concatenate([[-np.inf, most], right, np.nextafter(wrong, np.inf)]))
    at = at[at <= most]
    lost = np.searchsorted(np.sort(right), at) / len(right) + 1 - np.searchsorted(np.sort(wrong), at) / len(wrong)
    return float(at[lost.argmin()])


def training_rows(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The bounded sample: rows out of the held-out fold, with text and lang, smallest id hashes first in each language.

    Hashes beyond the share of its language that the sample needs are dropped in the scan, so few rows reach the driver at any size;
    languages beyond SAMPLE / LEAST are learned by the most frequent ones first.
    """
    labelled = docs.select("doc_id", "text", "lang").where((common.crc_fold("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE // LEAST).collect()
    total, h = sum(r["n"] for r in counts), F.xxhash64("doc_id") / 2.0**64 + 0.5
    wanted = {r["lang"]: max(min(LEAST, r["n"]), SAMPLE * r["n"] // total) for r in counts}
    if not wanted:
        return [], []
    within = F.lit(False)
    for r in counts:
        within = within | ((F.col("lang") == r["lang"]) & (h <= min(1.0, (1.5 * wanted[r["lang"]] + 30) / r["n"])))
    rows = labelled.where(within).select(h.alias("h"), "doc_id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text"))).alias("k"), "text")
    most = F.lit(0)
    for lang, n in wanted.items():
        most = F.when(F.col("lang") == lang, n).otherwise(most)
    rows = rows.where(F.col("k") <= most).orderBy("h", "doc_id").limit(SAMPLE + LEAST * len(wanted)).collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            text = common.large(batch.column(1))
            letters = pc.match_substring_regex(text, r"\pL")
            lang, value, low = [], [], np.full(len(text), m is None)
            for a, b in common.slices(text):
                has = letters.slice(a, b - a).to_numpy(zero_copy_only=False)
                if m is None:
                    best, p = np.full(b - a, -1), np.zeros(b - a)
                else:
                    best, found = odds(m, text.slice(a, b - a))
                    best, p, low[a:b] = np.where(has, best, -1), np.where(has, probability(found), 0.0), found < m.threshold
                lang += [m.languages[i] if i >= 0 else UND for i in best]
                value.append(p)
            value = np.concatenate(value) if value else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(value, pa.float64()), pa.array(low | np.array([x == UND for x in lang], bool))],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return common.bounded(docs).select("doc_id", "text", (common.crc_fold("doc_id", FOLDS) == HELD).alias("held_out")).mapInArrow(common.kernel(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(*training_rows(docs)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; lang becomes the predicted language.

    The rows are scored and passed on in one pass over the texts, so nothing is joined back.
    """
    model = train(*training_rows(docs))
    return annotate(docs, model).where(~F.col("rejected")).select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and rejected beside its columns (which come back unchanged)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        m = held.value
        for batch in batches:
            text = common.large(batch.column(at))
            letters = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
            lang, low = [], []
            for a, b in common.slices(text):
                best, p = odds(m, text.slice(a, b - a)) if m else (np.full(b - a, -1), np.zeros(b - a))
                for i, x, has in zip(best, p, letters[a:b]):
                    known = has and i >= 0
                    lang.append(m.languages[i] if known else UND)
                    low.append(not known or x < m.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(low, pa.bool_())], names=[*batch.schema.names, "lang_pred", "rejected"])

    return common.bounded(docs).mapInArrow(common.kernel(run), schema)


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}

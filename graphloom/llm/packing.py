"""Best-fit packing by minimum bin slack over the histogram of lengths.

1. Every document becomes token ids plus an end id; ones longer than a sequence are cut into full pieces and a rest.
   A text is tokenised by its white-space-free chunks (the tokenizer never looks across white space), so a
   chunk that comes again is looked up.
2. The pieces' lengths make a histogram of at most CAPACITY counts: all that the driver sees. For each sequence the
   longest piece left is placed and a subset-sum dynamic programme over the lengths left, one bit of an integer
   for each reachable sum, finds the fullest feasible filling; the combination is removed, as often as the counts
   allow at once. The work grows with the distinct lengths, not with the documents.
3. Pieces are ranked within their length (by hash buckets, so that no length is one task's) and the rank decides the
   sequence and the offset by a search in the table of combinations.

Defined results: a null or empty text is one piece that holds the end id; repeated rows are pieces each; extra columns
are ignored; an empty table gives an empty result; which of several equal-length pieces goes where is decided by
hash, doc_id and piece.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import common

CAPACITY, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers (a pipeline's fewer, as its executors have filled their heaps), and the longest one that it does.
REMEMBERED, REMEMBERED_LATE, LONGEST = 500_000, 100_000, 48
#: Punctuation that may end a chunk: it is tokenised apart from the letters before it.
TAIL = b".,!?;:*#$%&)"
#: Bytes of text that are looked up together.
SLICE = 1 << 23
#: Words that are encoded as one text.
JOINED = 2000


def _tokenizer(path: str) -> tuple:
    """(tokenizer, which ids end a word) of this process."""
    held = common.REMEMBERED.setdefault("packing", {}).setdefault("tokenizers", {})
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        vocabulary = t.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(t.model, "end_of_word_suffix", None) or "\0"
        for token, i in vocabulary.items():
            ends[i] = token.endswith(suffix)
        held[path] = (t, ends)
    return held[path]


def _whole(tokenizer, chunks: list[bytes]) -> dict[bytes, bytes]:
    """The ids of chunks, each encoded by itself."""
    out = {}
    for at in range(0, len(chunks), 4096):
        some = chunks[at : at + 4096]
        for w, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
            out[w] = array("I", e.ids).tobytes()
    return out


def _words(tokenizer, ends: np.ndarray, words: list[bytes]) -> dict[bytes, bytes]:
    """The ids of words of letters only: many are encoded as one text, and cut at the tokens that end a word."""
    out = {}
    for at in range(0, len(words), JOINED):
        some = words[at : at + JOINED]
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) != len(some) or cut[-1] != len(ids):  # every word has one end at least, so none has two where the counts agree
            out |= _whole(tokenizer, some)
            continue
        raw, start = ids.tobytes(), 0
        for w, stop in zip(some, (4 * cut).tolist()):
            out[w] = raw[start:stop]
            start = stop
    return out


def _letters(tokenizer, ends: np.ndarray, chars: set[str]) -> dict[str, bool]:
    """Of characters: does the tokenizer keep it in a word with letters beside it, and apart from punctuation after it?

    Its own tables decide: a capital may have a lower case that ends in a mark, which goes with the punctuation.
    """
    known = common.REMEMBERED.setdefault("packing", {}).setdefault("letters", {})
    new = [c for c in chars if c not in known]
    for at in range(0, len(new), 4096):
        some = new[at : at + 4096]
        for c, e in zip(some, tokenizer.encode_batch_fast([f"a{c}a{c}." for c in some], add_special_tokens=False)):
            known[c] = c.isalpha() and int(ends[e.ids].sum()) == 2
    return known


def encode(texts: list[bytes], path: str, word_ids: dict[bytes, bytes], remembered: int = REMEMBERED) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text.

    A chunk of letters (see ``_letters``) and closing punctuation is its word's ids (lower-cased, as the tokenizer does) and its
    tail's; any other chunk is encoded as it stands. ``word_ids`` remembers words from call to call.
    """
    tokenizer, ends = _tokenizer(path)
    if len(word_ids) > remembered:
        word_ids.clear()
    chunks = [t.split() for t in texts]
    seen = list(set().union(*chunks))
    cores = [w.lower().rstrip(TAIL) for w in seen]
    new = [c for c in set(cores).difference(word_ids) if c]
    wide = {c: c.decode() for c in new if not c.isascii()}
    chars = set("".join(wide.values()))
    letter = _letters(tokenizer, ends, chars)
    others = {c for c in chars if not letter[c]}
    new = [c for c in new if (others.isdisjoint(wide[c]) if c in wide else c.isalpha())]
    word_ids.update(_words(tokenizer, ends, new))
    here, odd, tails = {}, [], {b"": b""}
    for w, core in zip(seen, cores):
        ids = word_ids.get(core)
        if ids is None:
            odd.append(w)
        elif len(core) == len(w):
            here[w] = ids
        else:
            tail = w[len(core) :]
            if tail not in tails:
                tails[tail] = _whole(tokenizer, [tail])[tail]
            here[w] = ids + tails[tail]
    here |= _whole(tokenizer, odd)
    look = here.__getitem__
    out = [b"".join(map(look, ws)) for ws in chunks]
    for w in new:
        if len(w) > LONGEST:
            del word_ids[w]
    return out


def _pieces(path: str, capacity: int, end: int, remembered: int, size: int):
    last = array("I", [end]).tobytes()

    def run(batches):
        word_ids = common.REMEMBERED.setdefault("packing", {}).setdefault("words", {})
        for batch in batches:
            text = common.large(batch.column(1)).cast(pa.large_binary())
            ids = batch.column(0)
            for a, b in common.slices(text, size):
                row, piece, start, length, crc = [], [], [], [], []
                for i, tokens in enumerate(encode(text.slice(a, b - a).to_pylist(), path, word_ids, remembered)):
                    tokens += last
                    n = len(tokens) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        part = tokens[4 * at : 4 * (at + capacity)]
                        row.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of the lengths left (descending) with the largest sum of at most ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        before, left, k = reach, min(counts[n], room // n), 1
        while left > 0:  # binary splitting of the multiplicity
            take = min(k, left)
            reach |= (reach << (take * n)) & mask
            left -= take
            k *= 2
        steps.append((n, before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= n
            used += 1
        if used:
            chosen[n] = used
    return chosen


def combinations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: pieces of it}) in the order they are filled."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        n = lengths[0]
        counts[n] -= 1
        inner = fullest(capacity - n, lengths, counts)
        counts[n] += 1
        use = dict(inner)
        use[n] = use.get(n, 0) + 1
        times = min(counts[k] // m for k, m in use.items())
        out.append((times, use))
        gone = False
        for k, m in use.items():
            counts[k] -= m * times
            gone |= not counts[k]
        if gone:
            lengths = [k for k in lengths if counts[k]]
    return out


def slots(combos: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, first offset), sorted by length and rank."""
    rows, sequence, rank = [], 0, {}
    for times, use in combos:
        offset = 0
        for n, m in sorted(use.items(), reverse=True):
            at = rank.get(n, 0)
            rows.append((n, at, sequence, m, offset))
            rank[n] = at + m * times
            offset += m * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table):
    def run(batches):
        t = table.value
        key = (t[:, 0] << 44) | t[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = t[np.searchsorted(key, (length << 44) | rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            r = rank - row[:, 1]
            m = np.maximum(row[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + r // m), pa.array(row[:, 4] + r % m * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, remembered: int = REMEMBERED, size: int = SLICE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    return common.bounded(docs).select("doc_id", "text").mapInArrow(common.kernel(_pieces(path, capacity, end, remembered, size), "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The (settled) pieces with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    table = pieces.sparkSession.sparkContext.broadcast(slots(combinations(histogram, capacity)))
    # ranks within a length: about sqrt(n) hash buckets of about sqrt(n) rows for the most frequent length
    buckets = max(1, int(max(histogram.values(), default=1) ** 0.5))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    each = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = common.settle(each.select("length", "bucket", before.alias("base")), "pack-ranks")
    inner = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("within", F.row_number().over(inner) - 1).join(base, ["length", "bucket"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within")).cast("long").alias("rank")).mapInArrow(
        common.kernel(_place(table)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.settle(tokenised(common.table(spark, sf_dir, "documents"), tokenizer_path()), "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the pieces of all documents and their places."""
    return pack(common.settle(tokenised(docs, tokenizer_path(), remembered=REMEMBERED_LATE, size=SLICE // 4), "pieces"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}

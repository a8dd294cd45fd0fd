"""Temperature mixing of sources, realised as budgeted block permutations, in DataFrame functions only.

Source s holds the share p_s of all tokens. Under the exponent a its weight is p_s^a / sum p^a: a = 1 keeps the
shares, a = 0 makes them equal. The exponent is bisected to the smallest one (the flattest mixture) at which no source
is read more than ``max_repeats`` times while the least repeated one is read once, or to the largest one whose entropy
reaches ``entropy`` (as a share of log n); where both are given, the larger exponent holds, so the limit does.

The budget is then dealt by weight: a source of budget b_s is read epoch by epoch. Documents are hashed into blocks of
about ``BLOCK`` tokens; each epoch permutes a source's blocks by another hash, and the rows inside each block by
a third. Blocks are taken whole until the budget is reached; only the block at the boundary is cut, at the first row
that would begin past the budget. A running sum goes over blocks (few) and within one block (bounded), never over a
source, so a source with a third of all rows is dealt like any other.

Defined results: a null source is a source of its own; a null or empty text has 0 tokens, counts nothing and goes
with its block; repeated rows are rows of their own; extra columns pass through; an empty table gives an empty
result; a source without tokens keeps its rows once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import common

MAX_REPEATS = 1.5
#: Tokens of a block (bytes of text over 4 stand for tokens), levels of bisection that one job settles, and jobs.
BLOCK, LEVELS, JOBS = 1 << 18, 5, 6
#: How many rows a block holds at most on average, so that texts of no length are dealt too.
ROWS = 1 << 12
#: Up to so many rows (20 bytes each) of how often documents are read are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def tokens(text: Column) -> Column:
    """The token count that weights use: a quarter of the bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _ratio(shares: DataFrame, exponents: list[float], entropy: float | None, max_repeats: float | None) -> list[bool]:
    """For each exponent: does it satisfy the targets? (One job over the sources.)"""
    grid = F.array(*[F.lit(float(a)) for a in exponents])
    each = shares.where("p > 0").select("p", F.posexplode(grid).alias("k", "a"))
    rows = each.groupBy("k").agg(
        F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p") * F.col("a")).alias("e"), F.count(F.lit(1)).alias("n"),
        F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least"),
    )
    out = [True] * len(exponents)
    for r in rows.collect():
        flat = 1.0 if r["n"] < 2 else (math.log(r["z"]) - r["e"] / r["z"]) / math.log(r["n"])
        # larger exponents repeat less and have less entropy
        out[r["k"]] = max_repeats is None or r["most"] / r["least"] <= max_repeats + 1e-12
        if max_repeats is None and entropy is not None:
            out[r["k"]] = flat < entropy
    return out


def exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent in [0, 1] that meets the targets, by bisection, LEVELS halvings to a job."""

    def bisect(**target) -> float:
        low, high = 0.0, 1.0  # the predicate is false below the answer and true from it on
        if _ratio(shares, [0.0], **target)[0]:
            return 0.0
        for _ in range(JOBS):
            cells = 1 << LEVELS
            at = [low + (high - low) * i / cells for i in range(1, cells)]
            held = _ratio(shares, at, **target)
            first = next((i for i, ok in enumerate(held) if ok), cells - 1)
            low, high = ([low] + at)[first], ([*at, high])[first]
        return high

    found = [bisect(entropy=None, max_repeats=max_repeats)] if max_repeats is not None else []
    if entropy is not None:
        found.append(bisect(entropy=entropy, max_repeats=None))
    return max(found, default=1.0)


def weights(sources: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """(source, n_tokens, weight, repeats) from (source, n_tokens): repeats is how often each is read, least once."""
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    shares = sources.withColumn("p", F.col("n_tokens") / F.lit(float(max(total, 1))))
    a = exponent(shares, entropy, max_repeats)
    powers = shares.where("p > 0").agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.min(F.pow("p", F.lit(a - 1))).alias("least")).first()
    z, least = powers["z"] or 1.0, powers["least"] or 1.0
    some = F.col("p") > 0
    return shares.select(
        "source", "n_tokens", F.when(some, F.pow("p", F.lit(a)) / z).otherwise(0.0).alias("weight"), F.when(some, F.pow("p", F.lit(a - 1)) / least).otherwise(1.0).alias("repeats")
    )


def sources_of(docs: DataFrame) -> DataFrame:
    """(source, n_tokens, n_rows) of every source; sums are partial before the shuffle."""
    return docs.select("source", tokens(F.col("text")).alias("t")).groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, seed: int = 0) -> DataFrame:
    """``docs`` dealt by the weights: (row, epoch, block) numbers the copies; see ``plan`` for the columns.

    ``budget``: tokens in all; by default the smallest budget under which every source is read at least once.
    """
    source_key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    h = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    meta = common.settle(docs.select(source_key.alias("key"), "doc_id", h.alias("h"), tokens(F.col("text")).alias("t")), "mix-rows")
    copies = plan(meta, entropy, max_repeats, budget, seed)
    return copies


def plan(meta: DataFrame, entropy: float | None, max_repeats: float | None, budget: int | None, seed: int) -> DataFrame:
    """(doc_id, h, source, epoch, block, place, n_tokens, weight): one row for each time a document is read."""
    raw = common.settle(meta.groupBy("key").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows")), "mix-sources")
    w = weights(raw.select(F.col("key").alias("source"), "n_tokens"), entropy, max_repeats)
    goal = F.col("weight") * F.lit(float(budget)) if budget is not None else F.col("repeats") * F.col("n_tokens")
    s = common.settle(
        w.withColumnRenamed("source", "key").join(raw.select("key", "n_rows"), "key").select(
            "key", "n_tokens", "weight", goal.alias("goal"), F.greatest(F.ceil(F.col("n_tokens") / BLOCK), F.ceil(F.col("n_rows") / ROWS), F.lit(1)).cast("long").alias("n_blocks"), F.when(F.col("n_tokens") > 0, F.ceil(F.round(goal / F.col("n_tokens"), 9))).otherwise(1).cast("int").alias("epochs")
        ),
        "mix-weights",
    )
    rows = meta.join(s.select("key", "n_blocks"), "key").select("key", "doc_id", "h", "t", F.pmod("h", "n_blocks").alias("block"))
    blocks = common.settle(rows.groupBy("key", "block").agg(F.sum("t").alias("bt")), "mix-blocks")
    # each epoch reads the blocks in another order; a running sum over a source's blocks gives what came before each
    each = blocks.join(s, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    order = W.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    dealt = each.withColumn("before", F.coalesce(F.sum("bt").over(order), F.lit(0)) + F.col("epoch") * F.col("n_tokens"))
    whole = F.col("before") + F.col("bt") <= F.col("goal") + 1e-6
    some = whole | (F.col("before") < F.col("goal")) | (F.col("n_tokens") == 0)
    dealt = common.settle(dealt.where(some).select("key", "block", "epoch", "before", "goal", "weight", (~whole & (F.col("n_tokens") > 0)).alias("cut")), "mix-dealt")
    copies = rows.join(dealt, ["key", "block"])
    inner = W.partitionBy("key", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "h"), "h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    cut = copies.where("cut").withColumn("within", F.coalesce(F.sum("t").over(inner), F.lit(0))).where(F.col("before") + F.col("within") < F.col("goal")).drop("within")
    return copies.where("NOT cut").unionByName(cut).select(
        "doc_id", "h", F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), "epoch", "block", F.xxhash64(F.lit(seed), "epoch", "h").alias("place"), F.col("t").alias("n_tokens"), "weight"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "block", "place", "n_tokens", F.round("weight", 9).alias("weight"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of the mixture; a document that is read twice comes twice. No document is lost.

    How often each row is read is joined by (doc_id, hash of the text), so no text is shuffled where that table is small
    enough to broadcast. Rows equal in both are read alike, rounding up.
    """
    columns = docs.columns
    d, h, n = (common.column_name(docs, x) for x in ("_doc", "_hash", "_times"))
    key = F.xxhash64(F.lit(0), "doc_id", F.xxhash64("text"))
    rows = docs.select("doc_id", key.alias("h")).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    reads = mix(docs).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("reads"))
    same = reads["h"].eqNullSafe(rows["h"]) & reads["doc_id"].eqNullSafe(rows["doc_id"])
    times = common.settle(reads.join(rows, same).select(reads["doc_id"].alias(d), reads["h"].alias(h), F.ceil(F.col("reads") / F.col("rows")).cast("int").alias(n)).where(F.col(n) > 1), "mix-times")
    more = F.broadcast(times) if times.count() <= BROADCAST_ROWS else times
    both = docs.join(more, docs["doc_id"].eqNullSafe(more[d]) & (key == more[h]), "left")
    return both.select(*[docs[c] for c in columns], F.explode(F.sequence(F.lit(1), F.coalesce(n, F.lit(1)))).alias(n)).select(*columns)


QUERIES = {"op3_mixing": op3_mixing}
SQL: dict[str, str] = {}

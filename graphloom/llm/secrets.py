"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns. The strict kinds (assign, access, hex: the base) always stay. Further generators
propose provider keys, tokens and private-key headers. Every candidate's value is hashed and aggregated over
the whole corpus by distinct repository (a text; its copies count once) and owner (source): a value that several owners
and several repositories hold is a widely copied example, any other is live-looking. ``spans`` has every span, base and added, and
``all_spans`` each with its class, as kind:start:stop:class:repositories:owners. The two classes are counted (``n_live``, ``n_example``).

Positions come from splitting at the pattern: the gaps and matches alternate, so their lengths add up to the
offsets, in code points. Values are aggregated in two steps (distinct holders of each value, then per value), so a value
that a third of all documents hold is summed before the shuffle.

Defined results: null and empty texts have no spans; all rows of null source are one owner, apart from an empty source; of spans
that start together the kind as listed decides; repeated rows
give repeated results and one repository; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: kind, pattern, group of the value, shortest value. The first three are the base, in their fixed order.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    ("provider", r"(?<![A-Za-z0-9_])(?:gh[opsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,64}|xox[abpr]-[A-Za-z0-9-]{10,72}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20})(?![A-Za-z0-9_])", 0, 16),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("private", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 40),
)
#: A value of at least so many owners and repositories is a widely copied example.
OWNERS, REPOSITORIES = 2, 2
#: Where none of these is found a text has no candidate at all (a cheaper first look at every text).
_ANY = "|".join(p for _, p, _, _ in (*BASE, *ADDED)).replace("(?i:password|passwd|secret|token|api_?key)[\"']?", "(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[A-Za-z]*[\"']?")

_SPANS = "array<struct<start:long,rank:int,kind:string,stop:long,value:string>>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """The spans of one kind, by start: leftmost non-overlapping matches whose value is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), value.alias("value"))
    span = lambda at, x: F.struct(
        (at + F.length(x["gap"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"), x["value"].alias("value")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
        F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span(acc["at"], x)).cast(_SPANS))).otherwise(acc["out"]).alias("out"),
    )
    none = F.array().cast(_SPANS)
    return F.when(F.size(found) > 0, F.aggregate(rows, start, step)["out"]).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, owner, copy, base, added) of every row: spans by start, then kind as listed; copies of a text share ``copy``."""
    text = F.coalesce("text", F.lit(""))
    kinds = [matches(F.col("text"), *k, rank=i) for i, k in enumerate((*BASE, *ADDED))]
    some = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("owner"), text.alias("text")).withColumn("some", F.col("text").rlike(_ANY))
    none = F.array().cast(_SPANS)
    n = len(BASE)
    return some.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", F.when(F.col("some"), F.sha2("text", 256)).alias("copy"),
        F.when(F.col("some"), F.array_sort(F.concat(*kinds[:n]))).otherwise(none).alias("base"),
        F.when(F.col("some"), F.array_sort(F.concat(*kinds[n:]))).otherwise(none).alias("added"),
    )


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_docs, n_owners) of every value in (copy, owner, value_hash) rows."""
    holders = F.array(F.struct(F.lit(True).alias("is_owner"), F.col("owner").alias("holder")), F.struct(F.lit(False).alias("is_owner"), F.col("copy").alias("holder")))
    each = spans.select("value_hash", F.inline(holders)).distinct()
    return each.groupBy("value_hash").agg(F.sum((~F.col("is_owner")).cast("long")).alias("n_docs"), F.sum(F.col("is_owner").cast("long")).alias("n_owners"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, all_spans) of every row."""
    found = common.settle(candidates(docs), "secrets")
    each = found.where((F.size("base") > 0) | (F.size("added") > 0)).select("row", "owner", "copy", F.inline(F.concat("base", "added"))).withColumn("value_hash", F.sha2("value", 256))
    owned = common.settle(ownership(each), "owners")
    live = (F.col("n_owners") < OWNERS) | (F.col("n_docs") < REPOSITORIES)
    text = F.concat_ws(":", "kind", "start", "stop")
    per_row = (
        each.select("row", "value_hash", "rank", "start", text.alias("text"))
        .join(owned, "value_hash")
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "rank", "text", F.concat_ws(":", "text", F.when(live, "live").otherwise("example"), "n_docs", "n_owners").alias("full")))).alias("every"),
            F.sum(live.cast("long")).alias("n_live"),
            F.sum((~live).cast("long")).alias("n_example"),
        )
        .select(F.col("row").alias("at"), F.array_join(F.transform("every", lambda x: x["text"]), ",").alias("spans"), "n_live", "n_example", F.array_join(F.transform("every", lambda x: x["full"]), ",").alias("all_spans"))
    )
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base_text = F.array_join(F.transform("base", lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    left = found.select("row", "doc_id", *[count(k[0]) for k in BASE], F.sha2(base_text, 256).alias("base_sha256"))
    return left.join(per_row, left["row"] == per_row["at"], "left").select(
        "doc_id", *[f"n_{k[0]}" for k in BASE], "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"), F.coalesce("all_spans", F.lit("")).alias("all_spans")
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_secrets": op9_secrets}
SQL: dict[str, str] = {}

"""A triple-pattern algebra: bindings are DataFrames with one column per variable, an unbound variable is null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _match(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Bindings of one triple pattern; terms that start with ? are variables."""
    out, names = triples, {}
    for column, term in zip(("s", "p", "o"), pattern):
        if not term.startswith("?"):
            out = out.where(F.col(column) == term)
        elif term[1:] in names:
            out = out.where(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return out.select(*[F.col(c).alias(n) for n, c in names.items()])


def bgp(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern: constants are pushed to the scan, connected patterns are joined first."""
    left = [(p, _match(triples, p)) for p in patterns]
    out = left.pop(0)[1]
    while left:
        i = next((i for i, (_, d) in enumerate(left) if set(d.columns) & set(out.columns)), 0)
        out = join(out, left.pop(i)[1])
    return out


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compatible bindings; with no shared variable every pair (of solutions, which callers keep few)."""
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared) if shared else a.join(b)


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join where shared variables may be unbound on a side: unbound is compatible with anything and takes its value."""
    shared = [c for c in a.columns if c in b.columns]
    right = b.select(*[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in b.columns])
    on = reduce(lambda x, y: x & y, [F.col(c).isNull() | F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")) for c in shared], F.lit(True))
    return a.join(right, on).select(*[F.coalesce(c, f"_{c}").alias(c) if c in shared else F.col(c) for c in a.columns], *[c for c in b.columns if c not in shared])


def optional(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [c for c in a.columns if c in b.columns], "left")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a without a compatible one in b; with no shared variable all stay."""
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared, "left_anti") if shared else a


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def bind(a: DataFrame, name: str, value: str | Column) -> DataFrame:
    """Binds a variable; where it is bound already only equal solutions stay."""
    value = F.lit(value) if isinstance(value, str) else value
    return a.where(F.col(name) == value) if name in a.columns else a.withColumn(name, value)


def number(name: str) -> Column:
    """The numeric value of a literal, null where it is none."""
    return F.col(name).try_cast("double")


def aggregate(a: DataFrame, keys: list[str], **what: tuple[str, str]) -> DataFrame:
    """Grouping: ``out=(function, variable)`` with count, count_distinct, sum, avg, min, max and their _distinct forms;
    ``*`` counts solutions. Numbers only count where they parse."""
    made = {
        "count": lambda c: F.count(F.lit(1)) if c == "*" else F.count(c),
        "count_distinct": lambda c: F.count_distinct(F.struct(*a.columns)) if c == "*" else F.count_distinct(c),
        "sum": lambda c: F.sum(number(c)), "avg": lambda c: F.avg(number(c)), "min": lambda c: F.min(number(c)), "max": lambda c: F.max(number(c)),
        "sum_distinct": lambda c: F.sum_distinct(number(c)), "avg_distinct": lambda c: F.sum_distinct(number(c)) / F.count_distinct(number(c)),
    }
    if any(f.removesuffix("_distinct") not in ("count", "sum", "avg", "min", "max") for f, _ in what.values()):
        raise ValueError("unknown aggregate")
    cols = [made[f if f in made else f.removesuffix("_distinct")](c).alias(out) for out, (f, c) in what.items()]
    return a.groupBy(*keys).agg(*cols)


def coefficients(expression: str) -> dict[str, float]:
    """``?x + 2*?y - ?z`` as {variable: coefficient}."""
    out: dict[str, float] = {}
    for sign, factor, name in re.findall(r"([+-]?)\s*(?:([0-9.]+)\s*\*\s*)?\?(\w+)", expression):
        out[name] = out.get(name, 0.0) + (-1.0 if sign == "-" else 1.0) * float(factor or 1)
    return out


def top_k(a: DataFrame, expression: str, k: int, descending: bool = False) -> DataFrame:
    """The k solutions of least (or largest) linear score over numeric literals; non-numbers drop out."""
    c = coefficients(expression)
    rows = a.where(reduce(lambda x, y: x & y, [number(n).isNotNull() for n in c]))
    score = F.round(reduce(lambda x, y: x + y, [number(n) * w for n, w in c.items()]), 6)
    rows = rows.withColumn("score", score)
    return rows.orderBy(F.desc("score") if descending else F.asc("score"), *a.columns).limit(k)


def ask(a: DataFrame) -> DataFrame:
    """(answer): whether there is a solution; one row is enough to know."""
    return a.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def insert(triples: DataFrame, new: DataFrame) -> DataFrame:
    return triples.unionByName(new.select(*triples.columns)).distinct()


def delete(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def construct(a: DataFrame, template: list[tuple[str, str, str]]) -> DataFrame:
    """Triples of the template for every solution, as INSERT or DELETE WHERE takes them."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    return reduce(DataFrame.unionByName, [a.select(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template]).dropna().distinct()


def dictionary(triples: DataFrame) -> DataFrame:
    """(id, term): every term once; ids are hashes, so that no global sort numbers them."""
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()
    return terms.select(F.xxhash64("term").alias("id"), "term")


def hop_index(triples: DataFrame) -> DataFrame:
    """(e, p, least, most, witness, second, second_witness): per entity and path the range of the numeric values reached, and the two
    largest with the nodes that hold them (ties: the smaller node first).

    Paths are a predicate of the entity's own, ``p/q`` over one hop, and ``^p/q`` over one hop backwards. The two largest and the
    least are kept by aggregates that combine before the shuffle, so a node with many neighbours is not one task's.
    """
    values = triples.select(F.col("s").alias("w"), F.col("p").alias("q"), F.col("o").try_cast("double").alias("x")).where("x IS NOT NULL").distinct()
    path = lambda sign: F.concat(F.lit(sign), "p", F.lit("/"), "q").alias("p")
    there = triples.select(F.col("s").alias("e"), "p", F.col("o").alias("w")).join(values, "w").select("e", path(""), "x", "w")
    back = triples.select(F.col("o").alias("e"), "p", F.col("s").alias("w")).join(triples.select(F.col("s").alias("e")).distinct(), "e", "left_semi").join(values, "w").select("e", path("^"), "x", "w")
    own = values.select(F.col("w").alias("e"), F.col("q").alias("p"), "x", "w")
    rows = own.unionByName(there).unionByName(back)
    best = rows.groupBy("e", "p").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    first = rows.join(best, ["e", "p"]).where("x = most").groupBy("e", "p").agg(F.min("w").alias("witness"))
    rest = rows.join(first, ["e", "p"]).where("w <> witness")
    second = rest.groupBy("e", "p").agg(F.max("x").alias("second"))
    holder = rest.join(second, ["e", "p"]).where("x = second").groupBy("e", "p").agg(F.min("w").alias("second_witness"))
    return best.join(first, ["e", "p"]).join(second.join(holder, ["e", "p"]), ["e", "p"], "left").select("e", "p", "least", "most", "witness", "second", "second_witness")

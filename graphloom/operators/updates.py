"""Updates of a triple table: each gives the next version as a DataFrame. A table is a set of (s, p, o) without nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.triples import bgp

KEY = ["s", "p", "o"]


def insert(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """With ``rows`` added; rows that are there already come once. The table is met only on the probe side of a
    semi-join, so it isn't shuffled where the rows are few enough for the planner to broadcast."""
    new = rows.select(KEY).na.drop().distinct()
    present = triples.join(new, KEY, "left_semi").select(KEY)
    return triples.select(KEY).unionByName(new.join(present, KEY, "left_anti"))


def delete(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """Without ``rows``; absent ones are ignored."""
    return triples.select(KEY).join(rows.select(KEY), KEY, "left_anti")


def instances(bindings: DataFrame, template: list[tuple[str, str, str]]) -> DataFrame:
    """The triples of a template under each binding; one with an unbound variable makes none."""
    term = lambda x: F.col(x[1:]).cast("string") if x.startswith("?") else F.lit(x)
    each = [bindings.select(*[term(x).alias(c) for c, x in zip(KEY, pattern)]) for pattern in template]
    return reduce(DataFrame.unionByName, each).na.drop().distinct()


def modify(triples: DataFrame, where: list[tuple[str, str, str]], remove: list[tuple[str, str, str]] = (), add: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Templates under the bindings of ``where`` in the table as it is: first ``remove`` goes, then ``add`` comes."""
    bindings = bgp(triples, where)
    out = delete(triples, instances(bindings, remove)) if remove else triples.select(KEY)
    return insert(out, instances(bindings, add)) if add else out


def replay(triples: DataFrame, log: DataFrame) -> DataFrame:
    """A log of (seq, op, s, p, o), op ``+`` or ``-``: the last entry of each triple decides (of equal seq, ``+``)."""
    last = log.groupBy(KEY).agg(F.max_by("op", F.struct("seq", (F.col("op") == "+").alias("plus"))).alias("op"))
    return insert(delete(triples, last.where("op = '-'")), last.where("op = '+'"))

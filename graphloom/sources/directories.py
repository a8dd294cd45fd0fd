"""Graph directories: the compact layout (text ids, float matrices) and the named, sharded one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"EMBEDBIN"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stats(spark: SparkSession, path: str) -> dict[str, int]:
    """key=value lines."""
    pairs = [r["value"].rstrip("\r").split("=", 1) for r in _lines(spark, path).collect() if "=" in r["value"]]
    return {k.strip(): int(v) for k, v in pairs}


def names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): the i-th non-blank line names id i. (A file's lines are numbered in one task, as their order says.)"""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for b in batches:
            s = b["value"].str.rstrip("\r")
            s = s[s.str.strip() != ""]
            yield pd.DataFrame({"id": np.arange(at, at + len(s)), "name": s.to_numpy()})
            at += len(s)

    return _lines(spark, path).coalesce(1).mapInPandas(number, "id long, name string")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, emb) of a float matrix file: two 32-bit counts (rows, dimension), then little-endian floats row by row."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                n, d = np.frombuffer(raw, "<u4", 2)
                x = np.frombuffer(raw, "<f4", int(n) * int(d), 8).reshape(n, d)
                for at in range(0, int(n), 10000):
                    yield pd.DataFrame({"id": np.arange(at, min(at + 10000, int(n))), "emb": list(x[at : at + 10000])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "id long, emb array<float>")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, emb) of record files: a magic, a 64-bit count and a 32-bit dimension, then (id, length, name, floats)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                if raw[:8] != MAGIC:
                    raise ValueError("not an embedding record file")
                count, dim, at = int(np.frombuffer(raw, "<u8", 1, 8)[0]), int(np.frombuffer(raw, "<u4", 1, 16)[0]), 20
                rows = []
                for _ in range(count):
                    i, size = (int(x) for x in np.frombuffer(raw, "<u4", 2, at))
                    name = raw[at + 8 : at + 8 + size].decode()
                    rows.append((i, name, np.frombuffer(raw, "<f4", dim, at + 8 + size)))
                    at += 8 + size + 4 * dim
                yield pd.DataFrame(rows, columns=["id", "name", "emb"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "id long, name string, emb array<float>")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="", escape="")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """nodes (v, name, emb), edges (edge_id, src, rel, dst), relations (rel_id, rel), node_types (v, type_id); checked.

    ``rel`` of an edge is the relation's name.
    """
    if exists(spark, f"{folder}/FactKG.graph.txt"):
        return _named(spark, folder)
    if not exists(spark, f"{folder}/edges.txt"):
        raise FileNotFoundError(f"no graph in {folder}")
    counts = stats(spark, f"{folder}/stats.txt")
    for key in ("node_num", "relation_num", "edge_num"):
        if key not in counts:
            raise ValueError(f"stats.txt lacks {key}")
    nodes = names(spark, f"{folder}/node_names.txt").withColumnRenamed("id", "v")
    relations = names(spark, f"{folder}/relation_names.txt").select(F.col("id").cast("int").alias("rel_id"), F.col("name").alias("rel"))
    raw = _table(spark, f"{folder}/edges.txt", "src long, rel_id int, dst long")
    _check(nodes.count() == counts["node_num"], "node names and node_num differ")
    _check(relations.count() == counts["relation_num"], "relation names and relation_num differ")
    bad = raw.where(~(F.col("src").between(0, counts["node_num"] - 1) & F.col("dst").between(0, counts["node_num"] - 1) & F.col("rel_id").between(0, counts["relation_num"] - 1)) | F.col("src").isNull())
    _check(bad.isEmpty(), "an edge is out of range")
    if exists(spark, f"{folder}/node_embeddings.bin"):
        emb = matrix(spark, f"{folder}/node_embeddings.bin").withColumnRenamed("id", "v")
        _check(emb.count() == counts["node_num"], "embeddings and node_num differ")
        nodes = nodes.join(emb, "v")
    else:
        nodes = nodes.withColumn("emb", F.lit(None).cast("array<float>"))
    edges = raw.join(F.broadcast(relations) if counts["relation_num"] <= 1 << 16 else relations, "rel_id").select(F.monotonically_increasing_id().alias("edge_id"), "src", "rel", "dst")
    return {"nodes": nodes, "edges": edges, "relations": relations, "node_types": spark.createDataFrame([], "v long, type_id int")}


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _named(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    relations = _table(spark, f"{folder}/relation_name_to_id.txt", "rel string, rel_id int").select("rel_id", "rel")
    ids = _table(spark, f"{folder}/node_name_to_id", "name string, v long")
    raw = _table(spark, f"{folder}/FactKG.graph.txt", "s string, rel string, d string")
    edges = raw.join(ids.select(F.col("name").alias("s"), F.col("v").alias("src")), "s", "left").join(ids.select(F.col("name").alias("d"), F.col("v").alias("dst")), "d", "left").join(relations, "rel", "left")
    _check(edges.where("src IS NULL OR dst IS NULL OR rel_id IS NULL").isEmpty(), "an edge names an unknown node or relation")
    nodes = ids
    if exists(spark, f"{folder}/node_embeddings"):
        emb = records(spark, f"{folder}/node_embeddings/*.bin").select(F.col("id").alias("v"), F.col("name").alias("n"), "emb")
        nodes = ids.join(emb, "v", "left")
        _check(nodes.where("n IS NOT NULL AND n <> name").isEmpty(), "an embedding record has another node's name")
        nodes = nodes.select("v", "name", "emb")
    types = spark.createDataFrame([], "v long, type_id int")
    if exists(spark, f"{folder}/FactKG.type_to_nodes.txt"):
        type_ids = _table(spark, f"{folder}/type_name_to_id.txt", "type string, type_id int")
        types = _table(spark, f"{folder}/FactKG.type_to_nodes.txt", "type string, name string").join(type_ids, "type").join(ids, "name").select("v", "type_id").distinct()
    return {"nodes": nodes, "edges": edges.select(F.monotonically_increasing_id().alias("edge_id"), "src", "rel", "dst"), "relations": relations, "node_types": types}


def result_lines(matches: DataFrame, layout: str = "plain") -> DataFrame:
    """(line): score|sid---rid---did|sname---rname---dname per pattern edge, from (rank, eid, score, src, rel_id, dst and names).

    ``plain`` has 8 digits; ``sorted`` puts the smaller id of an edge first, so that direction is lost; ``known`` writes
    edges that the graph lacks (null rel_id) as relation 0, UNKNOWN_REL; ``ranked`` begins with the rank and two spaces,
    has 9 digits, and leaves type triples out.
    """
    if layout not in ("plain", "sorted", "known", "ranked"):
        raise ValueError(f"unknown layout: {layout}")
    if layout == "sorted":
        swap = F.col("src") > F.col("dst")
        matches = matches.withColumns({c: F.when(swap, F.col(d)).otherwise(F.col(c)) for c, d in (("src", "dst"), ("dst", "src"), ("src_name", "dst_name"), ("dst_name", "src_name"))})
    if layout == "known":
        matches = matches.withColumns({"rel": F.when(F.col("rel_id").isNull(), "UNKNOWN_REL").otherwise(F.col("rel")), "rel_id": F.coalesce("rel_id", F.lit(0))})
    each = F.concat(F.lit("|"), F.concat_ws("---", "src", "rel_id", "dst"), F.lit("|"), F.concat_ws("---", "src_name", "rel", "dst_name"))
    if layout == "ranked":
        each = F.when(F.col("rel").isin(RDF_TYPE, f"<{RDF_TYPE}>"), "").otherwise(each)
    rows = matches.groupBy("rank").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("eid", each.alias("t")))).alias("e"))
    score = F.format_string("%.9g" if layout == "ranked" else "%.8g", "score")
    score = F.regexp_replace(F.regexp_replace(score, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")  # no zeros at the end
    head = F.concat("rank", F.lit("  "), score) if layout == "ranked" else score
    return rows.orderBy("rank").select(F.concat(head, F.array_join(F.transform("e", lambda x: x["t"]), "")).alias("line"))


def query_folders(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """(series, number, path) of the numbered pattern folders of root, or of the series folders in it, in the order in
    which they run: those of root itself (series ``queries``), then n4, n8 and so on, then other series by name."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if x.isDirectory() and not x.getPath().getName().startswith("."))

    found = []
    for top in folders(root):
        inside = [("queries", top, f"{root}/{top}")] if top.isdecimal() else [(top, x, f"{root}/{top}/{x}") for x in folders(f"{root}/{top}") if x.isdecimal()]
        found += [x for x in inside if fs.listStatus(jvm.org.apache.hadoop.fs.Path(x[2]))]
    rank = lambda series: -1 if series == "queries" else int(series[1:]) if series[:1] in "nN" and series[1:].isdecimal() else float("inf")
    return [(series, int(name), path) for series, name, path in sorted(found, key=lambda x: (rank(x[0]), x[0], int(x[1]), x[1]))]


def ntriples(edges: DataFrame) -> DataFrame:
    """(line): N-Triples of (src_name, rel, dst_name) with percent-encoded terms."""
    term = lambda c: F.concat(F.lit("<"), F.regexp_replace(F.url_encode(c), r"\+", "%20"), F.lit(">"))
    return edges.select(F.concat_ws(" ", term("src_name"), term("rel"), term("dst_name"), F.lit(".")).alias("line"))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """(s, p, o) of N-Triples lines in ``value``, duplicates removed."""
    part = lambda i: F.url_decode(F.regexp_extract("value", r"^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|\"(.*)\")", i))
    literal = F.regexp_extract("value", r"^<[^>]*>\s+<[^>]*>\s+\"((?:[^\"\\]|\\.)*)\"", 1)
    return lines.where(F.col("value").rlike(r"^\s*<")).select(part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(literal).alias("o")).distinct()

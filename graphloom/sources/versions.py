"""Backups of a triple table and its update log: any state is the newest backup before it with the log replayed.

A backup is a Parquet folder named by the last log entry that it includes. One that was cut short has no success
marker and is passed over, so a backup that fails harms nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.updates import KEY, replay
from graphloom.sources.directories import exists

LOG = "seq long, op string, s string, p string, o string"


def backup(triples: DataFrame, folder: str, seq: int) -> None:
    """Writes ``triples`` as the state after log entry ``seq`` (0: before any)."""
    triples.select(KEY).write.mode("overwrite").parquet(f"{folder}/upto={seq}")


def record(entries: DataFrame, folder: str) -> None:
    """Appends (seq, op, s, p, o) to the log."""
    entries.select("seq", "op", *KEY).write.mode("append").parquet(f"{folder}/log")


def backups(spark: SparkSession, folder: str) -> list[int]:
    """The log entries up to which whole backups reach, ascending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/upto=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())


def restore(spark: SparkSession, folder: str, seq: int | None = None) -> DataFrame:
    """The triples after log entry ``seq`` (None: after the whole log)."""
    whole = [x for x in backups(spark, folder) if seq is None or x <= seq]
    if not whole:
        raise FileNotFoundError(f"no backup in {folder}" + ("" if seq is None else f" up to {seq}"))
    triples = spark.read.schema("s string, p string, o string").parquet(f"{folder}/upto={whole[-1]}")
    if not exists(spark, f"{folder}/log"):
        return triples
    log = spark.read.schema(LOG).parquet(f"{folder}/log").where(F.col("seq") > whole[-1])
    return replay(triples, log if seq is None else log.where(F.col("seq") <= seq))

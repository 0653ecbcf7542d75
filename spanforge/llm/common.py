"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that words and lines are stripped of: \x20 and \x09-\x0D.
SPACE = "\x20\t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where none is set and all executors
    are on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at its end, but for those that are kept; what is returned from it may read only
    these."""
    stack = _open.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, readable after executors are lost.

    A kept table outlives the innermost ``scratch``. The plan's own shuffle files aren't needed any more; Spark's
    cleaner removes them once the driver's JVM has noticed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    spark._jvm.java.lang.System.gc()
    stack = _open.__dict__.setdefault("stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched (``lower`` would fold other alphabets too)."""
    return F.translate(c, UPPER, LOWER)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for a join that is never a broadcast: a table below Spark's bound takes many times its size on disk once it is
    gathered by the driver and hashed, and what grows with the documents must not pass there."""
    return df.hint("merge")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, component)`` for every node with an edge; component: its smallest node.

    Large-star and small-star passes alternate until nothing changes, O(log n) passes. Each pass is a
    grouped minimum (combined before the shuffle) and an equi-join, whose hot keys AQE can split.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(by_merge(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(by_merge(least), "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = written(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")

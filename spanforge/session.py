"""Session factory with the settings the engine expects, and tables that cut a plan in two."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and characters of them as JSON, that a settled table may have to be broadcast.
FEW, SHORT = 10_000, 4_000_000


def session(name: str = "spanforge", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew-join handling, Arrow transfer; ``conf`` wins."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). A temporary one, removed at the end, only where none is set and
    all executors are on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for a join that is never a broadcast: Spark goes by the size of files, and what a settled table or an explode makes
    of them takes many times that once the driver gathers and hashes it."""
    return df.hint("merge")


def few_or_merged(df: DataFrame) -> DataFrame | None:
    """``df`` settled, for a join on its other side: broadcast if it is counted to be small, else ``by_merge``; None if it has no row."""
    table = settled(df)
    rows = table.limit(FEW + 1).count()
    if not rows:
        return None
    small = rows <= FEW and table.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] <= SHORT
    return F.broadcast(table) if small else by_merge(table)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: worked out once, read by column, with statistics, and there after executors
    are lost. The folder's owner removes it."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

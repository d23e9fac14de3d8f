"""Session helpers: shared checkpoint folder, lineage cuts and bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and is no larger than this many rows of a few longs (about 8 MB).
BROADCAST_ROWS = 250_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``; only where that is unset (tests, single machine) a temporary folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        configured = os.path.join(tempfile.gettempdir(), "weftgraph-checkpoints")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


_MADE: list[str] = []


def clean_scratch(spark: SparkSession) -> None:
    """Delete all tables that ``written`` made in this process. Results that weren't written elsewhere become unreadable."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared checkpoint folder."""
    _MADE.append(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: no lineage, and it survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._weft_path = path
    return back


def written_counted(df: DataFrame, name: str, where: Column | None = None) -> tuple[DataFrame, int]:
    """``written`` and the number of rows (that meet ``where``), counted while they are written."""
    seen = Observation()
    back = written(df.observe(seen, F.count(F.lit(1) if where is None else F.when(where, 1)).alias("n")), name)
    return back, seen.get["n"]


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame made by ``written``."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
    path = jvm.org.apache.hadoop.fs.Path(df._weft_path)
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def small_or_plain(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within BROADCAST_ROWS, else unchanged."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df

"""Session defaults and shared storage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle that adaptive execution mustn't join."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the session runs on one machine (as in tests) a temporary
    folder is used; on a cluster a folder of one machine would lose rows, so that is refused.
    """
    ctx = spark.sparkContext
    at = ctx.getCheckpointDir() if hasattr(ctx, "getCheckpointDir") else None
    if at:
        return at
    conf = ctx.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="clausemill-")
    ctx.setCheckpointDir(conf)
    return ctx.getCheckpointDir() or conf


_made: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared folder; cleanup() deletes it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cleanup(spark: SparkSession | None = None) -> None:
    """Delete what this session has put into the shared folder; DataFrames over it can't be read any more."""
    spark = spark or SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may have ended
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while _made:
            p = path(_made.pop())
            p.getFileSystem(conf).delete(p, True)


atexit.register(cleanup)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it outlives a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

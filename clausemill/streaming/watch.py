"""Folder watching by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausemill.operators import index as I
from clausemill.sources import readers


def rescan(spark: SparkSession, folder: str, source: str, index: DataFrame) -> DataFrame:
    """What a full rescan of a folder changes against the live index (deletions come from the listing)."""
    return I.scan_diff(readers.scan(spark, folder, source), index.where(~F.coalesce("deleted", F.lit(False))))


def watch(spark: SparkSession, folder: str, checkpoint: str, on_change: Callable[[DataFrame, int], None], once: bool = False, every: str = "2 seconds") -> StreamingQuery:
    """Call ``on_change`` for each batch of new or changed files; stop with ``query.stop()``.

    The file source gives paths; content hashes make re-processing idempotent, and the
    callback rescans for deletions. Changes within ``every`` come as one batch, so that a
    burst of them is scanned once. ``once`` catches up with what is there and ends.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    hashed = files.select("path", "modificationTime", F.sha2("content", 256).alias("content_hash"))
    writer = hashed.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def ingest_stream(spark: SparkSession, table: str, schema, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Stream a growing Parquet table through a stateless transformation into ``out``, exactly once; catches up and ends."""
    rows = spark.readStream.schema(schema).parquet(table)
    return transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

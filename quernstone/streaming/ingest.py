"""Incremental ingestion: new and changed Markdown files of a folder go into the index store as a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import IndexStore
from ..sources.files import as_text


def ingest(spark: SparkSession, folder: str, store: IndexStore, checkpoint: str, clock: Callable[[], datetime], pattern: str = "*.md") -> StreamingQuery:
    """Start a query that takes up what is there now and ends. A replayed batch changes nothing: the store's hashes
    leave out what it has, and an upsert replaces whole documents."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    files = files.select(path.alias("path"), "modificationTime", as_text(F.col("content")).alias("content"), F.sha2("content", 256).alias("file_hash"))
    files = files.withColumn("doc_id", F.substring(F.sha2("path", 256), 1, 16))

    def take(batch, _) -> None:
        last = Window.partitionBy("doc_id").orderBy(F.desc("modificationTime"))
        newest = batch.withColumn("n", F.row_number().over(last)).where("n = 1").select("doc_id", "path", "content", "file_hash")
        stale = store.stale(newest).persist()
        if not stale.isEmpty():
            store.index(stale, clock())
        stale.unpersist()

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

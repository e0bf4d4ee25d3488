"""Sharding by longest-processing-time scheduling: groups of equal texts, largest first, go to the least-loaded shard.

The heap does not see single groups: groups of equal size are interchangeable, so it is fed (size, number of groups) in
descending size. Distinct sizes number at most sqrt(2 x bytes), far fewer in practice, and are streamed to the driver a
partition at a time; what c groups of one size do to the heap is found by a search for the level that they fill."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, ranked, text_key, whole_text

PLAN = "group_size long, low long, high long, shard int"


def lpt(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, first rank, rank after the last, shard) of runs (size, groups) in descending size.

    Equal to popping the heap once for every group: of equally loaded shards the one with the smallest number takes
    the next group."""
    heap = [(0, j) for j in range(shards)]
    for size, count in runs:
        given = dict.fromkeys(range(shards), 0)
        if size > 0 and count > 8 * shards:
            # the last groups are dealt singly: below the level, each shard takes its groups without a look at the others
            low, high = heap[0][0], max(heap)[0] + size * count
            while low < high:
                level = (low + high + 1) // 2
                if sum(max(0, (level - load + size - 1) // size) for load, _ in heap) <= count:
                    low = level
                else:
                    high = level - 1
            for k, (load, j) in enumerate(heap):
                given[j] = max(0, (low - load + size - 1) // size)
                heap[k] = (load + size * given[j], j)
            heapq.heapify(heap)
        for _ in range(count - sum(given.values())):
            load, j = heap[0]
            given[j] += 1
            heapq.heapreplace(heap, (load + size, j))
        low = 0
        for j, n in given.items():
            if n:
                yield size, low, low + n, j
                low += n


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law `bytes`, shard, slot (gapless from 0 in
    each shard), grown_shard (null: another shard count deals anew).

    Equal texts share a shard; a null text counts as an empty one; rows may repeat, each gets a slot; null ids come
    first; other columns are ignored; an empty table gives none."""
    spark, text = docs.sparkSession, whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text_key(text).alias("text_key"))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("group_size"))
    groups = ranked(groups, ["group_size"], ["text_key"], "rank", "groups")
    sizes = groups.groupBy("group_size").agg(F.count("*").alias("n")).orderBy(F.desc("group_size"))
    plan = _written(spark, lpt(((r[0], r[1]) for r in sizes.toLocalIterator()), shards))
    of = groups.alias("g").join(plan.alias("p"), (F.col("g.group_size") == F.col("p.group_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = rows.join(of.select("text_key", "shard"), "text_key").withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).drop("text")
    placed = ranked(placed, ["shard"], ["text_key", "doc_id"], "slot", "placed")
    return placed.select(F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _written(spark, rows: Iterator[tuple], step: int = 200_000) -> DataFrame:
    """The schedule as a table in the shared folder, sent in pieces."""
    path, piece, first = new_folder(spark, "schedule"), [], True
    for row in rows:
        piece.append(row)
        if len(piece) == step:
            spark.createDataFrame(piece, PLAN).write.mode("append").parquet(path)
            piece, first = [], False
    if piece or first:
        spark.createDataFrame(piece, PLAN).write.mode("append").parquet(path)
    return spark.read.schema(PLAN).parquet(path)

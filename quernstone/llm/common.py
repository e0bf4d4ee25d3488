"""Helpers shared by the operators of this subpackage: storage that survives lost executors, ranks without one hot
partition, connected components, and file access that works for any shared file system."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a temporary one serves if
    everything runs in one process; on a cluster that would be another disk for each machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN.setdefault("dir", "") or "file://" + tempfile.mkdtemp(prefix="quernstone-")
        _OWN["dir"] = found
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has got. What is written there lives until the application ends."""
    key = f"{spark.sparkContext.applicationId} {shared_dir(spark)}"
    if key not in _OWN:
        _OWN[key] = f"{shared_dir(spark)}/quernstone-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_OWN[key])
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{_OWN[key]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts the lineage, and a lost executor costs no rerun."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "lz4_raw").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def commit_file(uri: str, temporary: str) -> None:
    """Move a finished temporary file to its name; attempts write equal bytes, so the last one may win."""
    filesystem, path = open_fs(uri)
    filesystem.move(open_fs(temporary)[1], path)


def whole_text(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text.cast("binary")))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, of: str) -> DataFrame:
    """Add the rank from 0 within keys, in the given order. Rows are dealt out by range over keys and order, so a key
    with most of the rows takes many partitions; counts of the partitions before are then added."""
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    spread = stored(spread, of)
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    counts = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = spread.withColumn("_inside", F.row_number().over(inside) - 1).join(counts, ["_part", *keys])
    return out.withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_part", "_inside", "_before")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node that can be reached.

    Every round hooks each component to its smallest neighbour, follows the hooks twice, and goes on with the edges
    between different components only, so the edges shrink; all is joins and minima, and each round is written to the
    shared folder."""
    edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("x")).select("x.*")
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hooks = stored(hooks, "hooks")
        for _ in range(2):
            up = hooks.select(F.col("a").alias("to"), F.col("to").alias("top"))
            hooks = hooks.join(up, "to", "left").select("a", F.coalesce("top", "to").alias("to"))
        hooks = stored(hooks, "hooks")
        if labels is None:
            labels = nodes.join(hooks, nodes.node == hooks.a, "left").select("node", F.coalesce("to", "node").alias("component"))
        else:
            labels = labels.join(hooks, labels.component == hooks.a, "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = stored(labels, "labels")
        at_u = hooks.select(F.col("a").alias("u"), F.col("to").alias("u2"))
        at_v = hooks.select(F.col("a").alias("v"), F.col("to").alias("v2"))
        edges = edges.join(at_u, "u", "left").join(at_v, "v", "left").select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v"))
        edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.select("node", F.col("node").alias("component")) if labels is None else labels


def forest(u: Iterable[int], v: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(node, smallest node of its tree) of the links, without the roots: as few links as keep what is connected."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for a, b in zip(u, v, strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    for x in list(up):
        if (r := root(x)) != x:
            yield x, r

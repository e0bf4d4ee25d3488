"""Markdown files as DataFrames: globs, whole texts and content hashes."""

from __future__ import annotations

import fnmatch
import glob
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_id

FILES = "doc_id string, path string, content string, file_hash string"


def _matcher(pattern: str) -> re.Pattern:
    """A file name pattern; a `/` in it matches no name."""
    return re.compile(r"(?!)" if "/" in pattern else fnmatch.translate(pattern))


def find_files(pattern: str) -> list[str]:
    """Files (not folders) that match, in order. `base/**/name` looks in all folders below base for the name; what
    follows a second `**` is ignored. Hidden files count."""
    if not pattern:
        raise ValueError("pattern is required")
    if "**" in pattern:
        base, name = pattern.split("**")[:2]
        wanted = _matcher(name.removeprefix("/") or "*")
        found = [os.path.join(folder, f) for folder, _, names in os.walk(base.removesuffix("/") or ".") for f in names if wanted.match(f)]
    else:
        if _broken(pattern):
            raise ValueError("invalid glob pattern: syntax error in pattern")
        found = glob.glob(pattern, include_hidden=True)
    found = sorted(f for f in found if os.path.isfile(f))
    if not found:
        raise FileNotFoundError(f"no files match pattern: {pattern}")
    return found


def _broken(pattern: str) -> bool:
    return any(x.count("[") > x.count("]") for x in pattern.split("/"))


def as_text(content: Column) -> Column:
    """Bytes as UTF-8; what isn't valid becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, path, content, file_hash) of whole files. Names that Spark's readers leave out (with a leading dot or
    underscore) are read through a list; the rest in parallel, path as asked for. Files that are gone, or that can't be
    read, have no row."""
    paths = [p for p in paths if os.path.isfile(p) and os.access(p, os.R_OK)]
    hidden = [p for p in paths if os.path.basename(p)[0] in "._"]
    shown = [p for p in paths if p not in set(hidden)]
    out = None
    if shown:
        names = spark.createDataFrame([(os.path.abspath(p), p, path_id(p)) for p in shown], "absolute string, path string, doc_id string")
        raw = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load([f"file://{_quoted(os.path.abspath(p))}" for p in shown])
        raw = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("absolute"), "content")
        raw = raw.withColumn("absolute", F.try_url_decode(F.replace("absolute", F.lit("+"), F.lit("%2B"))))
        out = raw.join(names, "absolute").select("doc_id", "path", as_text(F.col("content")).alias("content"), F.sha2("content", 256).alias("file_hash"))
    if hidden:
        rows = [(path_id(p), p, raw) for p in hidden if (raw := _bytes(p)) is not None]
        few = spark.createDataFrame(rows, "doc_id string, path string, raw binary").select("doc_id", "path", as_text(F.col("raw")).alias("content"), F.sha2("raw", 256).alias("file_hash"))
        out = few if out is None else out.unionByName(few)
    return spark.createDataFrame([], FILES) if out is None else out


def _bytes(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _quoted(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, path, file_hash)."""
    return read_files(spark, paths).select("doc_id", "path", "file_hash")

"""The index store: Parquet tables of documents and chunks, versioned and checked by content hashes."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.chunker import chunk
from ..operators.index import full_postings

VERSION = 4
DOCUMENTS = "doc_id string, path string, source_url string, file_hash string, indexed_at timestamp, num_chunks long, version int, bucket int"
CHUNKS = "chunk_id string, doc_id string, path string, title string, heading_path array<string>, start_line int, end_line int, text string, code_blocks array<struct<language:string,code:string,line:int>>, table_rows array<struct<cells:array<string>,line:int>>, has_code boolean, terms array<string>, embedding array<float>, bucket int"
POSTINGS = "doc_id string, chunk_id string, term string, tf long, df long, length int, num_chunks long, avg_len double, has_code boolean, bucket int"
RAW = "doc_id string, content string, bucket int"
FILES = "doc_id string, path string, source_url string, file_hash string, content string, bucket int"
BUCKETS = 64
#: Bytes of stored chunks whose postings one task makes, so that it needs no disk for that.
PART_BYTES = 12 << 20


def _struct(schema: str) -> StructType:
    return StructType.fromDDL(schema)


class IndexStore:
    """Tables `documents`, `chunks`, `postings` (with document frequencies) and `markdown` under one folder, each partitioned by a hash bucket of doc_id, so that
    an upsert rewrites the buckets it touches only and a lookup reads one."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """Documents of this version; others have to be indexed anew."""
        return self._read("documents", DOCUMENTS).where(F.col("version") == VERSION).drop("bucket")

    def _of(self, name: str, schema: str, doc_id: str | None) -> DataFrame:
        """A table, or what it has of one document, for which one bucket is read."""
        rows = self._read(name, schema)
        if doc_id is not None:
            bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id)), F.lit(self.buckets))).first()[0]
            rows = rows.where((F.col("bucket") == bucket) & (F.col("doc_id") == doc_id))
        return rows.drop("bucket")

    def chunks(self, doc_id: str | None = None) -> DataFrame:
        return self._of("chunks", CHUNKS, doc_id)

    def postings(self, doc_id: str | None = None) -> DataFrame:
        return self._of("postings", POSTINGS, doc_id)

    def markdown(self, doc_id: str | None = None) -> DataFrame:
        return self._of("markdown", RAW, doc_id)

    def get(self, doc_id: str) -> DataFrame:
        return self._of("documents", DOCUMENTS, doc_id).where(F.col("version") == VERSION)

    def _own_chunks(self, docs: DataFrame) -> DataFrame:
        """The stored chunks of these documents, from their buckets."""
        return self._read("chunks", CHUNKS).where(F.col("bucket").isin(*self._buckets(docs))).drop("bucket").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")

    def _buckets(self, docs: DataFrame) -> list[int]:
        """The buckets of these documents: as many numbers as the store has buckets at most."""
        return [r[0] for r in docs.select(self._bucket().alias("bucket")).distinct().collect()]

    def stale(self, files: DataFrame) -> DataFrame:
        """Rows of files (doc_id, path, file_hash, ...) that the store lacks in this version with this path and content."""
        known = self.documents().select("doc_id", "path", "file_hash")
        return files.join(known, ["doc_id", "path", "file_hash"], "left_anti")

    def index(self, files: DataFrame, indexed_at: datetime, max_lines: int = 0, min_lines: int = 0) -> DataFrame:
        """Chunk and store files (doc_id, path, content, file_hash[, source_url]); the documents' rows.

        files is read once. Each table is made of the one before as it has been written, bucket by bucket; only terms are dealt
        out again, by document."""
        if "source_url" not in files.columns:
            files = files.withColumn("source_url", F.lit(None).cast("string"))
        with self._beside() as beside:
            # a bucket is dealt to many tasks where it is large; Spark puts small parts together
            self._write(beside, "markdown", files, FILES, F.pmod(F.hash("doc_id"), F.lit(1024)))
            read = self._read_in(beside, "markdown", FILES)
            self._write(beside, "chunks", chunk(read, max_lines, min_lines).withColumn("embedding", F.lit(None).cast("array<float>")), CHUNKS)
            pieces = self._read_in(beside, "chunks", CHUNKS)
            parts = self._bytes(f"{beside}/chunks") // PART_BYTES
            by = {"bucket": self._bucket(), "part": F.pmod(F.hash("doc_id"), F.lit(max(16, 4 * parts // self.buckets)))}
            self._write(beside, "postings", full_postings(pieces, by, parts if parts > self.spark.sparkContext.defaultParallelism else None), POSTINGS)
            counts = pieces.groupBy("doc_id").agg(F.count("*").alias("num_chunks"))
            known = read.select("doc_id", "path", "source_url", "file_hash").join(counts, "doc_id", "left").withColumns({"indexed_at": F.lit(indexed_at).cast("timestamp"), "num_chunks": F.coalesce("num_chunks", F.lit(0)).cast("long"), "version": F.lit(VERSION)})
            self._write(beside, "documents", known, DOCUMENTS, F.lit(0))
            buckets = self._written(beside, "markdown")
            for name, schema in (("markdown", FILES), ("chunks", CHUNKS), ("postings", POSTINGS), ("documents", DOCUMENTS)):
                self._keep_others(beside, name, schema, read, buckets)
            for name in ("markdown", "chunks", "postings", "documents"):
                self._put(beside, name, buckets)
        return self._read("documents", DOCUMENTS).where(F.col("bucket").isin(*buckets)).drop("bucket").join(files.select("doc_id").distinct(), "doc_id", "left_semi")

    def put_embeddings(self, vectors: DataFrame) -> None:
        """Store vectors (doc_id, chunk_id, embedding) with their chunks."""
        touched = vectors.select("doc_id").distinct()
        own = self._own_chunks(touched).drop("embedding").join(vectors.select("doc_id", "chunk_id", "embedding"), ["doc_id", "chunk_id"], "left")
        with self._beside() as beside:
            self._write(beside, "chunks", own, CHUNKS, F.lit(0))
            buckets = self._written(beside, "chunks")
            self._keep_others(beside, "chunks", CHUNKS, self._read_in(beside, "chunks", CHUNKS), buckets)
            self._put(beside, "chunks", buckets)

    @contextmanager
    def _beside(self) -> Iterator[str]:
        """A folder for tables on their way into the store: Spark can't overwrite what the same plan reads."""
        beside = f"{self.folder}/_next/{uuid.uuid4().hex}"
        try:
            yield beside
        finally:
            system, path = self._path(beside)
            system.delete(path, True)

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _bytes(self, folder: str) -> int:
        system, path = self._path(folder)
        return system.getContentSummary(path).getLength()

    def _write(self, folder: str, name: str, rows: DataFrame, schema: str, part: Column | None = None) -> None:
        """Write rows by bucket; with part, dealt to tasks by bucket and part."""
        rows = rows.withColumn("bucket", self._bucket()).select([f.name for f in _struct(schema)])
        rows = rows if part is None else rows.repartition("bucket", part)
        rows.write.mode("append").partitionBy("bucket").parquet(f"{folder}/{name}")

    def _read_in(self, folder: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{folder}/{name}")

    def _written(self, folder: str, name: str) -> list[int]:
        """The buckets that a table has there."""
        system, path = self._path(f"{folder}/{name}")
        if not system.exists(path):
            return []
        names = (x.getPath().getName() for x in system.listStatus(path))
        return sorted(int(x.removeprefix("bucket=")) for x in names if x.startswith("bucket="))

    def _keep_others(self, beside: str, name: str, schema: str, touched: DataFrame, buckets: list[int]) -> None:
        """Copy what these buckets hold of documents that aren't touched to the table beside."""
        held = [b for b in self._written(self.folder, name) if b in set(buckets)]
        if held:
            ids = touched.select("doc_id").distinct()
            old = self._read(name, schema).where(F.col("bucket").isin(*held)).join(ids, "doc_id", "left_anti")
            old.select([f.name for f in _struct(schema)]).repartition("bucket").write.parquet(f"{beside}/others-{name}")
            self._write(beside, name, self._read_in(beside, f"others-{name}", schema), schema)

    def _put(self, beside: str, name: str, buckets: list[int]) -> None:
        """Put the table's buckets from beside in the place of the store's."""
        for b in buckets:
            system, new = self._path(f"{beside}/{name}/bucket={b}")
            _, place = self._path(f"{self.folder}/{name}/bucket={b}")
            system.delete(place, True)
            if system.exists(new):
                system.mkdirs(place.getParent())
                if not system.rename(new, place):
                    raise OSError(f"can't move {new} to {place}")

    def list(self) -> DataFrame:
        return self.documents().select("doc_id", "path", "source_url", "num_chunks", "indexed_at").orderBy("doc_id")

    def export_json(self, doc_id: str, folder: str) -> str:
        """One document's index as an indented JSON file `<doc_id>.index.json`; its path."""
        head = self.get(doc_id).first()
        if head is None:
            raise LookupError("document not loaded (call docs_load first)")
        pieces = self.chunks(doc_id).orderBy("start_line")
        out = {k: v for k, v in head.asDict().items() if v is not None}
        out["indexed_at"] = head.indexed_at.isoformat()
        out["chunks"] = [json.loads(r[0]) for r in pieces.select(F.to_json(F.struct(*pieces.columns))).collect()]
        out["doc_freq"] = {r.term: r.df for r in self.postings(doc_id).select("term", "df").distinct().collect()}
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(os.path.abspath(folder), f"{doc_id}.index.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=2, ensure_ascii=False)
        return path

    def export_markdown(self, doc_id: str, folder: str) -> str:
        """One document's source as `<doc_id>.md`; its absolute path."""
        row = self.markdown(doc_id).first()
        if row is None:
            raise LookupError("document not loaded (call docs_load first)")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(os.path.abspath(folder), f"{doc_id}.md")
        with open(path, "w", encoding="utf-8") as f:
            f.write(row.content)
        return path

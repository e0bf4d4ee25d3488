"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page, each task writes gzip members (one a record) and rolls to a new file once the
compressed size is reached. Headers and digests are made anew from the payload, dates come from a parameter, so equal
input gives equal files. A file is written under a temporary name and renamed when complete; the manifest table, which
Spark commits, names the files that count, so what failed attempts left behind is never read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import commit_file, new_folder, open_fs

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, number int, file string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:quernstone:page:{page_id}>" if page_id is not None else f"<urn:quernstone:page:null:{payload_digest}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").split(":")[3]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str) -> bytes:
    """A response record, or, where keeper is given, a revisit record without the payload."""
    payload_digest = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, payload_digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if keeper is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: {_urn(keeper, '')}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"software: quernstone\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:quernstone:file:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = 1 << 28, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row, in ascending id; returns the manifest.

    Of rows with equal payloads of at least min_bytes, the one with the largest id is a response and the others are
    revisits of it; where rows repeat that id, the first is the response. A null payload is empty, a null url is left
    out. A row with a null id is always a response. Other columns are ignored; an empty table writes no file."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keys = rows.where(F.col("page_id").isNotNull() & (F.length("payload") >= min_bytes)).select("page_id", F.sha1("payload").alias("hex"))
    keepers = keys.groupBy("hex").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("hex", "keeper")
    keys = keys.join(keepers, "hex").distinct().select("page_id", F.lit(0).alias("kind"), "hex", "keeper", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("salt"))
    records = rows.select("page_id", F.lit(1).alias("kind"), F.sha1("payload").alias("hex"), F.lit(None).cast("long").alias("keeper"), "url", "payload", F.when(F.col("page_id").isNull(), F.hash("url", "payload")).otherwise(0).alias("salt"))
    both = keys.unionByName(records).repartitionByRange("page_id", "salt").sortWithinPartitions("page_id", "salt", "kind", "hex", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        filesystem, out, number, count, size, temporary, name = None, None, 0, 0, 0, "", ""
        at, known, done = None, {}, []

        def close() -> None:
            nonlocal out, number, count
            if out is not None:
                out.close()
                commit_file(name, temporary)
                done.append((part, number, name, count, size))
                out, number, count = None, number + 1, 0

        for batch in batches:
            for page_id, kind, hexed, keeper, url, body in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if page_id != at:
                    at, known = page_id, {}
                if kind == 0:
                    known[hexed] = keeper
                    continue
                if out is None:
                    base = f"part-{part:05d}-{number:05d}.warc.gz"
                    name, temporary = f"{folder}/{base}", f"{folder}/_temporary-{attempt}-{base}"
                    filesystem, path = open_fs(temporary)
                    filesystem.create_dir(os.path.dirname(path), recursive=True)
                    out = filesystem.open_output_stream(path, compression=None)  # else the name would make Arrow compress once more
                    data = _member(_info(base, date))
                    out.write(data)
                    size = len(data)
                refers = None if page_id is None else known.get(hexed)
                if refers is not None and refers == page_id and not known.get((hexed, "written")):
                    known[hexed, "written"] = True
                    refers = None
                data = _member(record(page_id, url, body, refers, date))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "file", "records", "bytes"])

    both.drop("salt").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _member(data: bytes) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record is cut off")
        yield headers, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """Per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, offset (its place in
    the file). Digests of responses are checked against their payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, path = open_fs(file)
                rows, seen = [], 0
                with filesystem.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse(stream):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        seen += 1
                        head, _, body = block.partition(b"\r\n\r\n")
                        payload_digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if digest(block) != headers["warc-block-digest"].removeprefix("sha1:") or kind == "response" and digest(body) != payload_digest:
                            raise ValueError(f"{file}: a digest does not fit in {headers['warc-record-id']}")
                        length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                        refers = headers.get("warc-refers-to")
                        rows.append((_page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), length, payload_digest, kind, refers and _page_of(refers), file, seen))
                        if len(rows) == 2000:
                            yield _batch(rows)
                            rows = []
                if seen != count:
                    raise ValueError(f"{file} has {seen} records, the manifest has {count}")
                if rows:
                    yield _batch(rows)

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "records").repartition(tasks, "file").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"])


def warc_digests(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files, read them back, and return a row per page; nulls, empty and equal
    payloads, repeated rows, empty tables and other columns: as in write_warc and read_warc."""
    manifest = write_warc(pages, new_folder(pages.sparkSession, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

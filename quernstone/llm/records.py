"""Token-ID / binary output: length-delimited records with masked checksums, and an offset index beside each file.

A shard `part-00000-of-00012.bin` holds, for each document, a frame

    length of payload, unsigned 64 bits | masked CRC-32 of those 8 bytes | payload | masked CRC-32 of the payload

(little-endian; a CRC is masked by rotating it right by 15 bits and adding 0xa282ead8, so that checksums of data that
hold checksums stay sound). The payload is: id of the document (signed 64 bits), width of an id in bytes (one byte: 2
where all ids of the shard's tokenizer fit, else 4; 128 more where the document has no id, and that is 0), and the ids. `part-...idx` has the offset of every frame as unsigned
64 bits, with the file's length at the end, so readers can shuffle single records. Files get their names when they are
complete; `manifest` is a table of what belongs to the data set, so files of failed attempts are never read."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import commit_file, new_folder, open_fs, whole_text
from .tokens import word_encoder

MANIFEST = "part int, file string, index string, records long, tokens long, bytes long"
_NO_ID = 128


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end; raises ValueError where a checksum doesn't fit."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError("damaged length")
    payload, crc = stream.read(int.from_bytes(head[:8], "little")), stream.read(4)
    if len(crc) < 4 or masked_crc(payload) != int.from_bytes(crc, "little"):
        raise ValueError("damaged payload")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qB", doc_id or 0, width | _NO_ID * (doc_id is None)) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if width & _NO_ID else doc_id, np.frombuffer(payload, f"<u{width & ~_NO_ID}", offset=9)


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", step: int = 512) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the manifest, which is stored beside the files.

    Null texts are empty (they hold the end id alone); null ids come first; repeated and null ids keep one frame per
    row, in the order of their texts; other columns are ignored; an empty table makes an empty manifest."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), whole_text(text_col).alias("t"))
    rows = rows.repartitionByRange("i").sortWithinPartitions("i", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = word_encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        name, offsets, tokens, at = f"{folder}/part-{part:05d}", [], 0, 0
        filesystem, path = open_fs(f"{folder}/_temporary-{part:05d}-{attempt}")
        filesystem.create_dir(os.path.dirname(path), recursive=True)
        with filesystem.open_output_stream(path + ".bin") as out:
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    some = batch.slice(lo, step)
                    for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                        data = frame(pack(doc_id, np.concatenate([ids, tail]), width))
                        offsets.append(at)
                        at += out.write(data) or len(data)
                        tokens += len(ids) + len(tail)
        if not offsets:
            filesystem.delete_file(path + ".bin")
            return
        with filesystem.open_output_stream(path + ".idx") as out:
            out.write(np.array([*offsets, at], "<u8").tobytes())
        for kind in (".idx", ".bin"):
            commit_file(name + kind, f"{folder}/_temporary-{part:05d}-{attempt}{kind}")
        row = [[part], [name + ".bin"], [name + ".idx"], [len(offsets)], [tokens], [at]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "index", "records", "tokens", "bytes"])

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_records(manifest: DataFrame) -> DataFrame:
    """(part, doc_id, first, ids as bytes of unsigned 32-bit integers), first being the ids before it in its file, and in
    the files before that where the manifest has their number as `before`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, count, before in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                filesystem, path = open_fs(file)
                first, seen, rows = before, 0, ([], [], [])
                with filesystem.open_input_stream(path, buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        for x, y in zip(rows, (doc_id, first, ids.astype("<u4").tobytes()), strict=True):
                            x.append(y)
                        first, seen = first + len(ids), seen + 1
                        if len(rows[0]) == 1000:
                            yield _rows(part, rows)
                            rows = ([], [], [])
                if seen != count:
                    raise ValueError(f"{file} has {seen} records, the manifest has {count}")
                if rows[0]:
                    yield _rows(part, rows)

    before = F.col("before") if "before" in manifest.columns else F.lit(0)
    files = manifest.select("part", "file", "records", before.cast("long").alias("before"))
    return files.repartition(_tasks(manifest), "part").mapInArrow(read, "part int, doc_id long, first long, ids binary")


def _rows(part: int, rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows[0]), pa.int32()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["part", "doc_id", "first", "ids"])


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_record(file: str, index: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the index: what a shuffled reader does."""
    filesystem, path = open_fs(index)
    with filesystem.open_input_file(path) as f:
        f.seek(8 * number)
        offset = int.from_bytes(f.read(8), "little")
    filesystem, path = open_fs(file)
    with filesystem.open_input_file(path) as f:
        f.seek(offset)
        return unpack(read_frame(f))


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the records of documents (doc_id, text), read them back, and return per document: doc_id, start (ids of
    all documents before it), n_tokens (with the end id), ids_crc32 (of its ids as unsigned 32-bit integers). Null and
    empty texts, null and repeated ids and empty tables: as in write_token_records; every row comes back."""
    manifest = write_token_records(docs, new_folder(docs.sparkSession, "records"), tokenizer, end_id)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    found = read_token_records(manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))))
    return found.select("doc_id", F.col("first").alias("start"), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

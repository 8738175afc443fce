"""Token ids in length-delimited binary record files with an offset index.

A data file is a run of records. A record is: payload length (unsigned 64-bit),
masked checksum of those 8 bytes, payload, masked checksum of the payload. A
checksum is a CRC-32, rotated right by 15 bits plus a constant, so that a checksum
over data that holds checksums stays sound. A payload is a flag (1: there is an
id), the document id (signed 64-bit), the byte width of a token id, and the ids;
everything is little-endian. Next to a data file lies its index: one fixed-size
entry per record (offset, id count, ids before it in the file), so that a reader
can fetch any record by number in shuffled order.

Files are written by tasks through Arrow file systems, under names of their own
per attempt; a table of the files that finished (the manifest) is saved after the
job, and only those are read. So a lost executor or a task that ran twice leaves
at most a stray file. Documents are dealt to files by ranges of doc_id.

Cases: a null or empty text is just the end id; null ids come first; rows of equal
id are ordered by text and all kept; a table without rows makes no files and reads
back as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import new_folder, partitions, save, table
from .tokens import default_path, encoder

HEAD, SUM, ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<QQQ")
META = struct.Struct("<BqB")
MASK = 0xA282EAD8
MANIFEST = "file string, documents long, tokens long, bytes long, part int"
ROWS = "file string, doc_id long, local long, n_tokens long, ids_crc32 long"
CHUNK_ROWS = 4096


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = HEAD.pack(len(payload))
    return b"".join((size, SUM.pack(masked(size)), payload, SUM.pack(masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next record's payload, or None at the end; raises ValueError on damage."""
    size = stream.read(HEAD.size)
    if not size:
        return None
    rest = stream.read(SUM.size)
    if len(size) < HEAD.size or len(rest) < SUM.size or SUM.unpack(rest)[0] != masked(size):
        raise ValueError("damaged record length")
    n = HEAD.unpack(size)[0]
    payload, rest = stream.read(n), stream.read(SUM.size)
    if len(payload) < n or len(rest) < SUM.size or SUM.unpack(rest)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return META.pack(doc_id is not None, doc_id or 0, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = META.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, dtype=f"<u{width}", offset=META.size)


def index_entry(offset: int, n: int, before: int) -> bytes:
    return ENTRY.pack(offset, n, before)


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_record(data_uri: str, number: int) -> tuple[int | None, np.ndarray]:
    """Record ``number`` of a data file, by its index."""
    files, path = open_fs(data_uri)
    with files.open_input_file(path.removesuffix(".rec") + ".idx") as index:
        index.seek(number * ENTRY.size)
        offset, _, _ = ENTRY.unpack(index.read(ENTRY.size))
    with files.open_input_file(path) as data:
        data.seek(offset)
        return unpack(read_frame(data))


def writer(folder: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        files, path = open_fs(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        data = index = None
        offset = tokens = documents = 0
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if data is None:
                        files.create_dir(path, recursive=True)
                        data = files.open_output_stream(f"{path}/{name}.rec")
                        index = files.open_output_stream(f"{path}/{name}.idx")
                    ids = enc.encode(text) + end
                    record = frame(pack(doc_id, ids, enc.width))
                    n = len(ids) // enc.width
                    index.write(index_entry(offset, n, tokens))
                    data.write(record)
                    offset, tokens, documents = offset + len(record), tokens + n, documents + 1
        finally:
            if data is not None:
                data.close()
                index.close()
        if documents:
            yield pa.RecordBatch.from_pylist(
                [{"file": f"{folder}/{name}.rec", "documents": documents, "tokens": tokens, "bytes": offset, "part": part}],
                schema=pa.schema(
                    [("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("part", pa.int32())]
                ),
            )

    return write


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            files, path = open_fs(uri)
            with files.open_input_stream(path, buffer_size=1 << 20) as stream:
                local, out = 0, []
                while (payload := read_frame(stream)) is not None:
                    doc_id, ids = unpack(payload)
                    out.append((doc_id, local, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    local += len(ids)
                    if len(out) == CHUNK_ROWS:
                        yield rows(uri, out)
                        out = []
                if out:
                    yield rows(uri, out)


def rows(uri: str, out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([uri] * len(out)), *[pa.array(c, type=pa.int64()) for c in cols]],
        names=["file", "doc_id", "local", "n_tokens", "ids_crc32"],
    )


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, files: int) -> DataFrame:
    """Writes doc_id, text as records in ascending doc_id; returns the manifest, a saved table."""
    ship_package(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = dealt.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return save(dealt.mapInArrow(writer(folder, tokenizer_path, end_id), MANIFEST), "records-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Per record: doc_id, start (ids of all records before it), n_tokens, ids_crc32.

    The window has a row per file; the files themselves are read by as many tasks as there are files.
    """
    ship_package(manifest.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    files = save(files, "records-files")
    found = files.select("file").repartition(partitions(manifest.sparkSession), "file").mapInArrow(reader, ROWS)
    return found.join(files, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op5_records(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes all documents as record files and digests what is read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_records(docs, new_folder(spark, "records"), tokenizer_path or default_path(), end_id, partitions(spark))
    return read_records(manifest)

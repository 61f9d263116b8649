"""Operator 4: token ids as length-delimited binary records with masked checksums and an offset index.

A record file is a run of frames. Fixed layout, little-endian:

    frame    length u64 | masked crc of the length u32 | sequence | masked crc of the sequence u32
    sequence bytes per id u8 | key is null u8 | key i64 | ids, 2 bytes each where the vocabulary allows, else 4
    index    for each record: key i64 | byte offset of its frame u64 | ids u64

The checksum is CRC-32, turned right by 15 bits and shifted by a constant as in common record formats,
so that a checksum stored inside a checked range doesn't spoil it. Files go to a shared folder through
``pyarrow.fs``. A task writes files of its own name and reports them only when they are closed, so
a task that is run again leaves nothing that a reader sees.

Defined cases: a null text counts as empty; an empty text is a record of the end id alone; a null key
sorts first; rows with one key are records of their own, in the order of their texts; an empty table
gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import Scratch, checkpointed, document_columns, small_arrow_batches
from skerry.llm.tokens import encoder
from skerry.sources.tables import read_table

MASK_DELTA = 0xA282EAD8
HEAD, TAIL, SEQUENCE, ENTRY = "<QI", "<I", "<BBq", "<qQQ"
READ_ROWS = 2000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(sequence: bytes) -> bytes:
    length = struct.pack("<Q", len(sequence))
    return b"".join((length, struct.pack(TAIL, masked_crc(length)), sequence, struct.pack(TAIL, masked_crc(sequence))))


def unframe(head: bytes, read) -> bytes:
    """The sequence behind a frame's head; read(n) gives the next n bytes."""
    length, check = struct.unpack(HEAD, head)
    if masked_crc(head[:8]) != check:
        raise ValueError("a record's length doesn't match its checksum")
    body = read(length + struct.calcsize(TAIL))
    if len(body) != length + struct.calcsize(TAIL) or struct.unpack(TAIL, body[length:])[0] != masked_crc(body[:length]):
        raise ValueError("a record doesn't match its checksum")
    return body[:length]


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class RecordFiles:
    """Where the records are: one entry for each file, in key order. There are as many as write tasks."""

    folder: str
    files: tuple[tuple[str, int, int, int], ...]  # name, records, ids, ids of all files before


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None) -> RecordFiles:
    """Encode ``doc_id, text`` and write the records to ``folder`` in ascending key order."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = document_columns(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, out, index, at, records, total = TaskContext.get().partitionId(), encoder(tokenizer), None, None, 0, 0, 0
        width = 2 if len(enc.tokenizer.get_vocab()) <= 1 << 16 and end_id < 1 << 16 else 4
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        fs, base = open_folder(folder)
        for batch in batches:
            if out is None:
                fs.create_dir(base, recursive=True)
                out, index = fs.open_output_stream(f"{base}/{name}.rec"), fs.open_output_stream(f"{base}/{name}.idx")
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py()), np.uint32(end_id)).astype(f"<u{width}")
                data = frame(struct.pack(SEQUENCE, width, key is None, key or 0) + ids.tobytes())
                out.write(data)
                index.write(struct.pack(ENTRY, key or 0, at, len(ids)))
                at, records, total = at + len(data), records + 1, total + len(ids)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "records": [records], "ids": [total]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

    rows = sorted(ordered.mapInArrow(write, "part int, name string, records long, ids long").collect())
    files, before = [], 0
    for r in rows:
        files.append((r.name, r.records, r.ids, before))
        before += r.ids
    return RecordFiles(folder, tuple(files))


def read_frames(folder: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Keys and ids of a file from front to back, every checksum tested."""
    fs, base = open_folder(folder)
    with fs.open_input_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as f:
        while head := f.read(struct.calcsize(HEAD)):
            yield parse(unframe(head, f.read))


def read_indexed(folder: str, name: str, block: int = 1 << 15) -> Iterator[tuple[int | None, np.ndarray]]:
    """Keys and ids of a file by way of its offset index, in the index's order; both must tell the same."""
    fs, base = open_folder(folder)
    size = struct.calcsize(ENTRY)
    with fs.open_input_stream(f"{base}/{name}.idx") as index, fs.open_input_file(f"{base}/{name}.rec") as f:
        while entries := index.read(size * block):
            for key, at, n in struct.iter_unpack(ENTRY, entries):
                f.seek(at)
                own, ids = parse(unframe(f.read(struct.calcsize(HEAD)), f.read))
                if (own or 0) != key or len(ids) != n:
                    raise ValueError("a record isn't what the index tells")
                yield own, ids


def read_at(folder: str, name: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Single records in any order, by way of the offset index: what a shuffled reader does."""
    fs, base = open_folder(folder)
    with fs.open_input_file(f"{base}/{name}.idx") as index, fs.open_input_file(f"{base}/{name}.rec") as f:
        out = []
        for k in numbers:
            index.seek(k * struct.calcsize(ENTRY))
            f.seek(struct.unpack(ENTRY, index.read(struct.calcsize(ENTRY)))[1])
            out.append(parse(unframe(f.read(struct.calcsize(HEAD)), f.read)))
        return out


def parse(sequence: bytes) -> tuple[int | None, np.ndarray]:
    width, null, key = struct.unpack(SEQUENCE, sequence[: struct.calcsize(SEQUENCE)])
    return (None if null else key), np.frombuffer(sequence, f"<u{width}", offset=struct.calcsize(SEQUENCE))


def read_digests(spark: SparkSession, records: RecordFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read back from the files by their indexes."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    folder = records.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, ids in read_indexed(folder, name):
                    rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                    start += len(ids)
                    if len(rows) == READ_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    files = spark.createDataFrame([(f[0], f[3]) for f in records.files], "name string, start long")
    return files.repartition(max(1, len(records.files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as records and read back; the files go when the digests are kept."""
    scratch = Scratch(spark, "records")
    written = write_records(read_table(spark, sf_dir, "documents"), f"{scratch.root}/files")
    out = checkpointed(read_digests(spark, written))
    scratch.drop()
    return out

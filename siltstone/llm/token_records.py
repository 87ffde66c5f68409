"""Token ids as framed binary records with a separate offset index.

A record is: payload length (8 bytes), masked checksum of those, payload, masked checksum of the payload; all
little-endian. A payload is one byte (1: the document has an id), the id (8 bytes), the width of a token id
(1 byte: 2, or 4 if one of them needs it), then the token ids. A checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum of bytes that
hold checksums themselves stays telling. The index has a row for each record with its file and offset, so that a
reader can fetch records in any order.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.encoding import encoder

_MASK = 0xA282EAD8
_INDEX = "file int, doc_id long, offset long, n_bytes long, n_tokens long"
_ROWS = "file int, doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(f) -> bytes | None:
    """The next payload of an open file, None at its end; ValueError if a checksum doesn't hold."""
    head = f.read(12)
    if not head:
        return None
    length, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("record length is damaged")
    body = f.read(length + 4)
    if len(body) != length + 4 or masked(body[:length]) != struct.unpack("<I", body[length:])[0]:
        raise ValueError("record is damaged")
    return body[:length]


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and token ids (as 4-byte numbers) of a payload."""
    has_id, doc_id, width = struct.unpack("<?qB", payload[:10])
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def _writer(folder: str, tokenizer_path: str, end_id: int):
    def run(batches):
        enc, n = encoder(tokenizer_path), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        trial, at = f"{base}/_trial-{n:06d}-{os.urandom(6).hex()}", 0
        with fs.open_output_stream(trial) as out:
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    index = []
                    for doc_id, ids in zip(part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist()), strict=True):
                        data = frame(serialize(doc_id, np.append(ids, end_id)))
                        out.write(data)
                        index.append((n, doc_id, at, len(data), len(ids) + 1))
                        at += len(data)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.int32(), *[pa.int64()] * 4), strict=True)], ["file", "doc_id", "offset", "n_bytes", "n_tokens"])
        # A task that runs again, after a loss or by speculation, puts the same bytes in the same place.
        fs.move(trial, f"{base}/part-{n:06d}.rec") if at else fs.delete_file(trial)

    return run


def write_token_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Writes folder/data/part-*.rec, in ascending doc_id order over files and within, and folder/index (Parquet).

    Each text is encoded whole and end_id appended; null counts as empty, so its record holds end_id alone. Rows
    without an id come first; rows of one id are ordered by a hash of their text; repeated rows each get a
    record. Columns other than doc_id and text are ignored; an empty table gives an empty index and no records.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(_writer(f"{folder}/data", tokenizer_path, end_id), _INDEX).write.parquet(f"{folder}/index")


def _reader(folder: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for n, start in zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(f"{base}/part-{n:06d}.rec", buffer_size=1 << 20) as f:
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = deserialize(payload)
                        rows.append((n, doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """file, doc_id, start (ids of all records before), n_tokens, ids_crc32 of each record, read from the data files."""
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    n_files = max(1, per_file.count())
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = per_file.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return files.repartition(n_files, "file").mapInArrow(_reader(f"{folder}/data"), _ROWS)


def fetch_records(folder: str, index_rows: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Token ids of the records at (file, offset, n_bytes), in the order given: what a shuffling reader does."""
    fs, base = pafs.FileSystem.from_uri(f"{folder}/data")
    out = []
    for n, offset, n_bytes in index_rows:
        with fs.open_input_file(f"{base}/part-{n:06d}.rec") as f:
            payload = read_frame(pa.BufferReader(f.read_at(n_bytes, offset)))
        out.append(deserialize(payload)[1])
    return out

"""Token ids as length-delimited binary records, with an offset index beside each shard.

A shard ``NNNNNN.rec`` is a run of records: length (8 bytes), masked checksum of the length (4), payload, masked checksum of the payload (4), all
little-endian. A payload is flags (1 byte: 1 the id is null, 2 ids are 4 bytes wide), doc_id (8 bytes, signed), then the ids (2 bytes each where the
vocabulary allows). The checksum is CRC-32 (zlib), masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32 so that checksums of data that
hold checksums stay independent. ``NNNNNN.idx`` has the 8-byte offset of each record, for reads in any order.

Documents are dealt out by ranges of doc_id, sorted, encoded once and written by the task that holds the range. A task writes
under a name of its own and renames at the end, so a repeated or lost task leaves no half shard. Reading back starts from the
manifest (one row a shard); each shard is streamed by one task, which checks every checksum.

Edge cases: a null or empty text gives a record with the end id alone; null doc_ids come first; rows that share an id are ordered by a hash of the text and
each keep a record; an empty table gives no shard and an empty result. A broken checksum or a cut file raises an error. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import materialize
from . import pieces

HEAD, ID = struct.Struct("<QI"), struct.Struct("<Bq")
_MANIFEST = pa.schema([("shard", pa.int64()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])
_RECORDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return ID.pack((doc_id is None) | (2 if width == 4 else 0), doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = ID.unpack_from(payload)
    return (None if flags & 1 else doc_id), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=ID.size)


def read_frame(stream) -> bytes | None:
    """The next payload of a stream; None at its end."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("cut record head")
    length, crc = HEAD.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("checksum of a length is wrong")
    body = stream.read(length + 4)
    if len(body) < length + 4 or masked_crc(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("checksum of a payload is wrong")
    return body[:-4]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` below ``path`` (shared by all executors) and returns the manifest, itself a stored table."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard, (store, base) = TaskContext.get().partitionId(), _place(path)
        store.create_dir(base, recursive=True)
        enc = pieces.encoder(tokenizer)
        end, offsets, at, n_tokens = np.array([end_id], enc.dtype).tobytes(), [], 0, 0
        name, own = f"{base}/{shard:06d}", f".{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(f"{name}.rec{own}", buffer_size=1 << 20) as out:
            while first is not None:
                ids = zip(first.column(0).to_pylist(), first.column(1), strict=True)
                for doc_id, text in ids:
                    data = enc.encode(text.as_py()) + end
                    n_tokens += len(data) // enc.dtype.itemsize
                    offsets.append(at)
                    framed = frame(pack(doc_id, data, enc.dtype.itemsize))
                    out.write(framed)
                    at += len(framed)
                first = next((b for b in batches if b.num_rows), None)
        with store.open_output_stream(f"{name}.idx{own}") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        for kind in ("rec", "idx"):
            store.move(f"{name}.{kind}{own}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_records": len(offsets), "n_tokens": n_tokens}], schema=_MANIFEST)

    return materialize(ranged.mapInArrow(task, "shard long, n_records long, n_tokens long"), "manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, start being the ids before it in shard order.

    Shard starts are a running sum over the manifest, which has a row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    dealt = starts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, base = _place(path)
                rows: list[tuple] = []
                with store.open_input_stream(f"{base}/{shard:06d}.rec", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return dealt.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_RECORDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS, strict=True)], schema=_RECORDS)


def read_at(path: str, shard: int, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of a shard with these numbers, in the order asked for, found through its index."""
    store, base = _place(path)
    with store.open_input_file(f"{base}/{shard:06d}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    out = []
    with store.open_input_file(f"{base}/{shard:06d}.rec") as f:
        for n in numbers:
            f.seek(int(offsets[n]))
            out.append(unpack(read_frame(f)))
    return out

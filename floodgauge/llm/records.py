"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A record file is a run of frames: unsigned 64-bit length, masked crc32 of the length bytes, the
payload, masked crc32 of the payload (all little-endian). A payload holds the doc_id, the width of an
id in bytes (2 or 4) and the ids. Files are in ascending doc_id order, over files and within them.
Each task writes under its own name and renames at the end, so that a repeated attempt is harmless.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodgauge.llm.common import blocks, scratch_dir, table
from floodgauge.llm.tokens import encoder

_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?qB")
NAME = "shard-{:06d}.rec"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return length + _CHECK.pack(masked(length)) + payload + _CHECK.pack(masked(payload))


def frames(file) -> Iterator[bytes]:
    """Payloads of an open record file; raises ValueError where a checksum or length is wrong."""
    while head := file.read(12):
        if len(head) < 12 or masked(head[:8]) != _CHECK.unpack(head[8:])[0]:
            raise ValueError("damaged length")
        n = _LENGTH.unpack(head[:8])[0]
        body = file.read(n + 4)
        if len(body) < n + 4 or masked(body[:n]) != _CHECK.unpack(body[n:])[0]:
            raise ValueError("damaged record")
        yield body[:n]


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 65536
    return _HEAD.pack(doc_id is not None, doc_id or 0, 2 if narrow else 4) + ids.astype("<u2" if narrow else "<u4").tobytes()


def parse(data: bytes) -> tuple[int | None, bytes]:
    known, doc_id, width = _HEAD.unpack(data[: _HEAD.size])
    ids = data[_HEAD.size :]
    return doc_id if known else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_records(docs: DataFrame, out_uri: str, path: str, spaced: bool, end_id: int, shards: int) -> DataFrame:
    """Write the files to ``out_uri`` (any file system that pyarrow and Spark both open) and return
    the index, stored beside them: shard, doc_id, offset, length, before (ids before it in its file),
    n_tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = _open(out_uri)
        fs.create_dir(folder, recursive=True)
        shard = task.partitionId()
        name, temp = f"{folder}/{NAME.format(shard)}", f"{folder}/.{shard}-{task.taskAttemptId()}.tmp"
        offset = before = 0
        with fs.open_output_stream(temp, buffer_size=1 << 20) as file:
            for batch in batches:
                for block in blocks(batch, "text"):
                    ids, bounds = encoder(path, spaced).encode(block.column(1), end_id)
                    rows = []
                    for doc_id, (a, b) in zip(block.column(0).to_pylist(), pairwise(bounds.tolist())):
                        data = frame(payload(doc_id, ids[a:b]))
                        file.write(data)
                        rows.append((shard, doc_id, offset, len(data), before, b - a))
                        offset += len(data)
                        before += b - a
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.int64()] * 5])], names=["shard", "doc_id", "offset", "length", "before", "n_tokens"])
        if fs.get_file_info(name).type.name != "NotFound":
            fs.delete_file(name)
        fs.move(temp, name)

    order = ["doc_id", "tie", "number"]  # so that rows of one doc_id are spread, and come in the same order again
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("number"))
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    index = ordered.mapInArrow(write, "shard int, doc_id long, offset long, length long, before long, n_tokens long")
    index.write.parquet(f"{out_uri}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{out_uri}/index")


def read_records(spark: SparkSession, uri: str, index: DataFrame, shards: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files and checked; the index
    gives each file's first id number. ``shards``: tasks to read with."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(uri)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{folder}/{NAME.format(shard)}", buffer_size=1 << 20) as file:
                    rows = []
                    for data in frames(file):
                        doc_id, ids = parse(data)
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return base.repartition(shards, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(uri: str, shard: int, offset: int) -> tuple[int | None, bytes]:
    """One record by its index entry, for shuffled reads."""
    fs, folder = _open(uri)
    with fs.open_input_file(f"{folder}/{NAME.format(shard)}") as file:
        file.seek(offset)
        return parse(next(frames(file)))


def shard_count(docs: DataFrame, most: int = 64 << 20, least: int = 8 << 20) -> int:
    """Files of at most about ``most`` bytes of text; more, down to ``least`` bytes, while there are
    fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // most), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // least)))


def token_records(docs: DataFrame, path: str | None = None, spaced: bool = False, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 read back from files of all documents in doc_id order.

    Null text counts as empty and gives the end id alone; a null doc_id comes first; rows repeated
    under one doc_id stand side by side; an empty table gives no rows; a very long text is one record.
    Strings of special tokens are coded as the library codes them. Only doc_id and text are read.
    """
    import public_tokenizers

    spark = docs.sparkSession
    uri, shards = scratch_dir(spark, "records"), shard_count(docs)
    index = write_records(docs, uri, path or public_tokenizers.path("word_bpe_49k.json"), spaced, end_id, shards)
    return read_records(spark, uri, index, shards)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"))

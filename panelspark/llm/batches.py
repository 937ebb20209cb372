"""Rows in stored batches, and an exchange of hashed keys between batches.

Operators that look up millions of keys per task send them as arrays, not as rows: a batch sorts
and combines its keys, cuts them by bucket (their top bits) and sends one array per bucket. The
bucket answers with one byte per key, in the same order, so no addresses travel. A key that a third
of all rows hold is sent once per batch. ``buckets`` follows the number of shuffle partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import slices
from panelspark.storage import cut_lineage


def packed(batch: pa.RecordBatch) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpacked(raw: bytes) -> pa.RecordBatch:
    import zstandard

    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_all().combine_chunks()
    return table.to_batches()[0]


def store(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """A table of ``batch`` and ``payload``: compressed rows with about ``limit`` bytes in ``column``.

    The batch number is (task << 20) + place in the task; an Arrow batch has fewer than 2^20 rows.
    """
    def pack(batches):
        task = TaskContext.get().partitionId() << 20
        for n, part in enumerate(slices(batches, column, limit)):
            yield pa.RecordBatch.from_arrays([pa.array([task + n]), pa.array([packed(part)], pa.binary())], names=["batch", "payload"])

    return cut_lineage(rows.mapInArrow(pack, "batch long, payload binary"), "batches")


def bucket_count(df: DataFrame) -> int:
    return 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Start of every bucket's run among sorted 64-bit keys (one more than buckets)."""
    step = (1 << 64) // buckets
    bounds = np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, bounds), [len(sorted_keys)]])


def sent(batch_id: int, columns: list[np.ndarray], buckets: int):
    """Rows (batch, bucket, keys) for columns of 64-bit numbers sorted by the first."""
    edges = bucket_edges(columns[0], buckets)
    full = np.flatnonzero(np.diff(edges))
    blobs = [b"".join(c[edges[i] : edges[i + 1]].tobytes() for c in columns) for i in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), batch_id)), pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())],
        names=["batch", "bucket", "keys"])


def answered(keys: DataFrame, width: int, decide) -> DataFrame:
    """``batch`` and ``answers``: per bucket, the bytes that ``decide`` gives for the keys of all batches.

    ``decide`` takes ``width`` arrays and returns one array of uint8.
    """
    def reply(group: pa.Table) -> pa.Table:
        blobs = group.column("keys").to_pylist()
        sizes = [len(b) // 8 // width for b in blobs]
        parts = [np.frombuffer(b, np.uint64).reshape(width, n) for b, n in zip(blobs, sizes, strict=True)]
        told = decide(*np.concatenate(parts, axis=1)).astype(np.uint8)
        ends = np.cumsum([0, *sizes])
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"),
                         "answer": pa.array([told[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    done = keys.groupBy("bucket").applyInArrow(reply, "batch long, bucket int, answer binary")
    return cut_lineage(done.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers")), "answers")


def told(answers) -> np.ndarray:
    """The answers of one batch in the order of its sorted keys."""
    return np.frombuffer(b"".join(x["answer"] for x in answers or []), np.uint8)

"""Blocks: rows packed into Arrow payloads of a few megabytes, so that operators in several passes move few, large rows.

A block is written once to the shared checkpoint folder; its ``block_id`` is then fixed, whatever executor reads it. The table is
bucketed by that id, and ids are chosen so that a task's blocks fall to four buckets, its own: a task writes few files, buckets
are even, and what is joined to blocks by id is shuffled to them while they stay where they are.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.checkpoints import checkpoint_dir, cut_by

#: Bytes of text in a block; one longer text is a block of its own, whole.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 50_000
#: Buckets, and so files, that a task writes its blocks to.
SPREAD = 4


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple[str, str], object] = {}


def kept(module: str, name: str, make: Callable[[str], object]):
    """What a worker process keeps between the tasks of a module, made on first use; a task of another module drops it."""
    if (module, name) not in _kept:
        _kept[module, name] = make(name)
    return _kept[module, name]


def _free() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """A task's function that gives freed memory back to the system when it ends, as the worker goes on to other tasks."""

    @wraps(f)
    def run(batches):
        if other := [k for k in _kept if k[0] != f.__module__]:
            for k in other:
                del _kept[k]
            _free()
        try:
            yield from f(batches)
        finally:
            _free()

    return run


def partitions_of(spark: SparkSession) -> int:
    """How many buckets to deal keys to: the session's shuffle partitions, which grow with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part has about ``most`` bytes of text at most, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + most, side="right"))), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and n+1 offsets; null counts as empty."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    joined = b"".join(column.fill_null("").cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist())
    return np.frombuffer(joined, np.uint8), offsets


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed bytes, its length in front."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    """The inverse of :func:`squeeze`."""
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype)


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as r:
        return r.read_next_batch()


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Spark's bucket of 64-bit ids: Murmur3 (32 bits, seed 42), modulo. A wrong answer would cost files, not rows."""
    with np.errstate(over="ignore"):
        h = np.full(len(ids), 42, np.uint32)
        for half in (ids & 0xFFFFFFFF, ids >> 32):
            k = half.astype(np.uint32) * np.uint32(0xCC9E2D51)
            k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
            h ^= k
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % buckets


def task_ids(task: int, buckets: int) -> Iterator[int]:
    """Ids for the rows of a task, in SPREAD buckets by turns; so tasks that are fewer than the buckets still fill them all."""
    wanted, start = [(task * SPREAD + k) % buckets for k in range(SPREAD)], task << 32
    for k in range(1 << 31):
        while True:
            ids = np.arange(start, start + 8 * buckets)
            found = np.flatnonzero(bucket_of(ids, buckets) == wanted[k % SPREAD])
            if len(found):
                break
            start += len(ids)
        start = int(ids[found[0]]) + 1
        yield start - 1


SCHEMA = "block_id bigint, n_rows bigint, n_bytes bigint, payload binary"
ARROW = pa.schema([("block_id", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())])


def write_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` in a table of blocks (block_id, n_rows, n_bytes of text, payload)."""
    buckets = partitions_of(df.sparkSession)

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = task_ids(TaskContext.get().partitionId(), buckets)
        for part in chunks(batches, text):
            size = pc.sum(pc.fill_null(pc.binary_length(part.column(text)), 0)).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([next(ids)]), pa.array([part.num_rows]), pa.array([size]), pa.array([pack(part)], pa.binary())], schema=ARROW)

    return cut_by(df.mapInArrow(build, SCHEMA), "block_id", buckets)

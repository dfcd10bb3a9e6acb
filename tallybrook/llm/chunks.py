"""Documents in chunks, and compact exchanges between chunks and key buckets.

Operators that look for what documents share work in chunks: a chunk is all documents of one hash value, a few MB of
text, so its contents don't depend on how Spark happens to place rows and a lost task can be run again. A chunk
boils its keys down to one sorted entry each before anything is sent, so a key that stands in a third of all documents
costs each bucket at most one entry a chunk. What is sent are binary runs, one row for each chunk and bucket.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, quoted

#: Chunks for each split of the scan.
PER_SPLIT = 4


def trim() -> None:
    """Gives freed memory back, which a worker would else hold while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def grouped(f):
    """A function of (key, table) that gives its memory back."""

    def run(key, table):
        try:
            return f(key, table)
        finally:
            trim()

    return run


def cogrouped(f):
    """A function of (key, left, right) that gives its memory back."""

    def run(key, left, right):
        try:
            return f(key, left, right)
        finally:
            trim()

    return run


def pack(*arrays) -> bytes:
    return zlib.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zlib.decompress(blob))


def chunked(docs: DataFrame, keep: list[str] | None = None, per_split: float = PER_SPLIT) -> tuple[DataFrame, int]:
    """chunk, doc_id, text and the columns of keep (as a struct `row` of numbered fields c0, c1, ..., whatever their
    names are); and the number of chunks."""
    n = chunk_count(docs, 1 / per_split)
    row = [F.struct(F.lit(0).alias("none"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("row")] if keep is not None else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *row)
    spread = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    return d.withColumn("chunk", F.pmod(spread, F.lit(n)).cast("int")), n


class Texts:
    """A chunk's documents in order of (doc_id, text), nulls first, over one buffer of bytes. Rows without id stand in the
    order of a digest of their text, which is the same in all chunks."""

    def __init__(self, table: pa.Table):
        missing = np.flatnonzero(~table["doc_id"].is_valid().to_numpy()) if table["doc_id"].null_count else np.zeros(0, int)
        ties = np.zeros(table.num_rows, np.uint64)
        if len(missing):
            texts = table["text"].take(missing).cast(pa.large_binary())
            ties[missing] = [int.from_bytes(hashlib.blake2b(t.as_py() or b"", digest_size=8).digest()) for t in texts]
        keys = pa.table({"id": table["doc_id"], "tie": pa.array(ties), "text": table["text"]})
        order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start")
        self.table = table.take(order)
        #: Those digests, 0 for rows with an id; none if all have one.
        self.ties = ties[order.to_numpy()] if len(missing) else None
        column = self.table["text"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        self.n = len(column)
        buffers = column.buffers()
        if self.n:
            self.at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + self.n + 1]
            self.data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        else:
            self.at, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.ids = self.table["doc_id"]
        #: Null ids stand before all others.
        self.id_or_least = pc.fill_null(self.ids, -(2**63)).to_numpy().astype(np.int64)
        self.memory = memoryview(self.data)

    def bytes_of(self, i: int) -> bytes:
        return bytes(self.memory[self.at[i] : self.at[i + 1]])

    def batches(self, size: int = 1 << 19):
        """(first, last) of runs of documents of about `size` bytes."""
        first = 0
        while first < self.n:
            last = int(np.searchsorted(self.at, self.at[first] + size, "left"))
            last = max(first + 1, min(last, self.n))
            yield first, last
            first = last


def bucket_of(v: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 48-bit keys: equal ranges, so that sorted keys fall into contiguous slices."""
    return ((v >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)


def slices(v: np.ndarray, buckets: int):
    """(bucket, start, stop) of sorted keys."""
    if not len(v):
        return
    b = bucket_of(v, buckets).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
        yield int(b[s]), int(s), int(e)


def six_bytes(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def table_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

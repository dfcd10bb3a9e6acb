"""Where excerpts stand in documents: seed and verify.

Every excerpt and every document is cut down to a few of its grams (Q characters), chosen by their hashes alone: of each W
grams in a row the least. A document that holds an excerpt therefore has all of the excerpt's chosen grams, at the same
distances. Documents' grams meet those of the excerpts in a hash join; of each excerpt the gram that is rarest in the
documents becomes its seed, and only where a seed stands are texts compared. Excerpts too short for that are sought by
whole windows of their length. Nothing is collected, and texts travel only if they hold a seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

Q, W = 8, 8
#: From this length on an excerpt holds a whole run of W grams.
LEAST = Q + W - 1
#: Characters of a text that are hashed at once.
PIECE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashed(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q characters in a row."""
    n = max(len(codes) - q + 1, 0)
    h = np.full(n, q, dtype=np.uint64)
    for k in range(q):
        h = h * _FACTOR + codes[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def chosen(text: str, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's chosen grams, and of all windows of the lengths given."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams, places = [], []
    for at in range(0, max(len(codes), 1), PIECE):
        h = _hashed(codes[at : at + PIECE + LEAST - 1], Q)
        if len(h) >= W:
            runs = np.lib.stride_tricks.sliding_window_view(h, W)
            own = np.unique(runs.argmin(1) + np.arange(len(runs)))
            grams.append(h[own])
            places.append(own + at)
        for n in lengths:
            h = _hashed(codes[at : at + PIECE + n - 1], n)
            grams.append(h)
            places.append(np.arange(len(h)) + at)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(places)


def _grams(rows: DataFrame, lengths: tuple[int, ...] = ()) -> DataFrame:
    """The rows' first columns, gram and at; the last column is the text."""
    *keys, text = rows.columns
    ddl = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "gram long, at int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(len(keys))):  # a text at a time, as it may have millions of grams
                g, at = chosen(value.as_py(), lengths)
                if len(g):
                    own = [pa.chunked_array([c]).take(pa.array(np.full(len(g), i))).combine_chunks() for c in batch.columns[: len(keys)]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(g), pa.array(at.astype(np.int32))], [*keys, "gram", "at"])

    return rows.mapInArrow(run, ddl)


def locate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """id, item, place (from 0, in characters) of the first stand of each excerpt in each document that holds it. docs: id,
    text; items: item, excerpt. Null texts hold nothing, null and empty excerpts are sought nowhere; rows that repeat an
    id are searched each."""
    docs = docs.filter("text IS NOT NULL").withColumn("digest", F.xxhash64("text"))
    items = items.filter("length(excerpt) > 0").distinct()
    short = F.length("excerpt") < LEAST
    lengths = tuple(sorted(r["n"] for r in items.filter(short).select(F.length("excerpt").alias("n")).distinct().collect()))  # at most LEAST - 1
    long_grams = _grams(items.filter(~short).select("item", "excerpt"))
    parts = [long_grams] + [_grams(items.filter(F.length("excerpt") == n).select("item", "excerpt"), (n,)) for n in lengths]
    sought = parts[0]
    for p in parts[1:]:
        sought = sought.union(p)
    sought = cut(sought.withColumnRenamed("at", "offset"))
    known = sought.select("gram").distinct()
    hits = cut(_grams(docs.select("id", "digest", "text"), lengths).join(known, "gram"))
    # an excerpt without any of its grams in the documents drops out here
    rare = sought.join(hits.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("item").agg(F.min_by(F.struct("gram", "offset"), F.struct("n", "offset")).alias("seed"))
    rare = rare.select("item", "seed.gram", "seed.offset")
    stands = hits.join(rare, "gram").select("id", "digest", "item", (F.col("at") - F.col("offset")).alias("place")).filter("place >= 0").distinct()
    texts = docs.withColumnsRenamed({"id": "doc", "digest": "doc_digest"})
    both = texts.join(stands, F.col("doc").eqNullSafe(F.col("id")) & (F.col("doc_digest") == F.col("digest"))).join(items, "item")
    same = F.substring("text", F.col("place") + 1, F.length("excerpt")) == F.col("excerpt")
    return both.filter(same).groupBy("id", "item").agg(F.min("place").cast("int").alias("place"))

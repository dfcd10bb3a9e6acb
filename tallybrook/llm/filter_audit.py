"""Interaction of filters: what each of five filters removes under every one of their 120 orders.

A document's failures are one number of five bits. A table of 32 x 120 entries, built once from the orders, says at which
step a document with these failures is removed, or that it stays; tasks look it up for all orders of a block of documents
at once and count by part, order and step with bincount: all documents, good ones and toxic ones. These arrays, 720
entries a part, are summed over tasks; everything else follows from them: what fails a filter is what an order that begins
with it removes at once, and what fails it alone is what an order that ends with it removes last.

Texts are read once, as bytes, piece by piece if long, and only ids, parts, digests and failures are shuffled. Identical
texts are found by SHA-256: the least doc_id of each digest is an aggregate, and joins back on digest and doc_id together,
so that a text in a third of all rows is spread by its ids.

Null texts count as empty. Rows without id are identical to no smaller id's text, nor is any row to theirs; rows that
repeat an id and a text count each and don't make one another fail. A part is a lang; null joins the empty string. A
document is good or toxic if any of its label rows says so; null labels and documents without say neither. Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

FILTERS = "ABCDE"
MIN_WORDS = 100
#: In per cent: distinct words of all words, capitals of all code points.
MIN_DISTINCT = 80
MAX_CAPITALS = 10
SYMBOLS = "#$%&*|"
#: Bytes of a text that are split into words at once; rows looked up at once; parts held by a task before it sends them on.
PIECE = 1 << 20
ROWS = 4096
PARTS = 256

ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: STEPS[failures, order]: the step that removes, from 1; 0: kept.
STEPS = np.array([[next((s for s, f in enumerate(o, 1) if failed >> FILTERS.index(f) & 1), 0) for o in ORDERS] for failed in range(1 << len(FILTERS))], dtype=np.int64)
_PLACES = len(FILTERS) + 1
_CELLS = len(ORDERS) * _PLACES
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(65, 91))
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that don't begin a code point
_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS).encode() + b"]")
_JUDGED = "doc_id long, part string, digest binary, failed int"
_COUNTED = "part string, cell int, removed long, good long, toxic long"
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end before white space."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    if len(text) <= PIECE:
        words = text.split()
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for piece in _pieces(text):
            words = piece.split()
            n += len(words)
            seen.update(words)
        distinct = len(seen)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INSIDE))
    failed = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * points, _SYMBOL.search(text) is not None)
    return sum(1 << i for i, f in enumerate(failed) if f)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, failed = [], []
        for text in batch.column(2):
            text = text.as_py()
            digests.append(hashlib.sha256(text).digest())
            failed.append(failures(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())], ["doc_id", "part", "digest", "failed"])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (all five filters), good, toxic and n: documents that agree in id, part and text as one row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    held = cut(texts.mapInArrow(_judge, _JUDGED).groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n")))
    first = held.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    both = held.join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    return both.select("part", (F.col("failed") + F.when(again, 1 << 4).otherwise(0)).alias("failed"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task as one array of removals for each part, cell by cell."""
    held: dict[str, np.ndarray] = {}

    def sent() -> pa.RecordBatch:
        parts = np.repeat(np.array(list(held), dtype=object), _CELLS)
        sums = np.stack(list(held.values())).transpose(1, 0, 2).reshape(3, -1)
        columns = [pa.array(parts, pa.string()), pa.array(np.tile(np.arange(_CELLS, dtype=np.int32), len(held))), *map(pa.array, sums)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["part", "cell", "removed", "good", "toxic"])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            parts = rows.column(0).dictionary_encode()
            failed, good, toxic, n = (np.asarray(rows.column(i), dtype=np.int64) for i in range(1, 5))
            cells = np.asarray(parts.indices)[:, None] * _CELLS + np.arange(len(ORDERS)) * _PLACES + STEPS[failed]
            size = len(parts.dictionary) * _CELLS
            # weights are doubles, so sums of a block are whole as long as they are below 2 ** 53
            sums = [np.bincount(cells.ravel(), np.repeat(w, len(ORDERS)), size).astype(np.int64).reshape(-1, _CELLS) for w in (n, n * good, n * toxic)]
            for i, part in enumerate(parts.dictionary.to_pylist()):
                block = np.stack([s[i] for s in sums])
                held[part] = held[part] + block if part in held else block
        if len(held) > PARTS:
            yield sent()
    if held:
        yield sent()


def _table(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
    """A part's 600 rows from its 720 sums."""
    cells = np.zeros((3, _CELLS), np.int64)
    cells[:, sums["cell"]] = sums[["removed", "good", "toxic"]].to_numpy().T
    removed, good, toxic = cells.reshape(3, len(ORDERS), _PLACES)
    total, rows = int(removed[0].sum()), []
    fails = {o[0]: removed[i, 1] for i, o in enumerate(ORDERS)}
    alone = {o[-1]: removed[i, -1] for i, o in enumerate(ORDERS)}
    shapley = {f: sum(removed[i, o.index(f) + 1] for i, o in enumerate(ORDERS)) for f in FILTERS}
    for i, order in enumerate(ORDERS):
        kept = total
        for step, f in enumerate(order, 1):
            here = removed[i, step]
            kept -= here
            rows.append((key[0], order, step, kept, here, fails[f] - here, alone[f], good[i, step], toxic[i, step], shapley[f]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    sums = judged(docs, labels).mapInArrow(_count, _COUNTED).groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))
    return sums.groupBy("part").applyInPandas(_table, _OUT)  # 720 rows a part, whatever its size


def oracle() -> str:
    bit = {f: f"((failed >> {i}) & 1)" for i, f in enumerate(FILTERS)}
    at = " ".join(f"WHEN '{f}' THEN {b}" for f, b in bit.items())
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS words FROM documents),
     f AS (SELECT doc_id, part, CAST(len(words) < {MIN_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) AS INT)
             + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MAX_CAPITALS} * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[{SYMBOLS}]') AS INT)
             + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS failed FROM w),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
     c AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, failed),
     e AS (SELECT unnest(string_split('{",".join(FILTERS)}', ',')) AS x),
     o AS (SELECT a.x || b.x || c.x || d.x || z.x AS filter_order FROM e a, e b, e c, e d, e z
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, z.x])) = 5),
     s AS (SELECT filter_order, step, filter_order[step] AS filter FROM o, range(1, 6) AS r(step)),
     g AS (SELECT c.*, filter_order, step, filter, CASE filter {at} END = 1 AS fails,
             len(list_filter(string_split(left(filter_order, step - 1), ''), lambda x: x <> '' AND CASE x {at} END = 1)) > 0 AS before,
             failed = CASE filter {' '.join(f"WHEN '{f}' THEN {1 << i}" for i, f in enumerate(FILTERS))} END AS alone FROM c, s),
     h AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT before AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
           FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM h"""

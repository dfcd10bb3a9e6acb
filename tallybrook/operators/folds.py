"""Folds over each key's rows in order, with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Result rows that are sent at once.
SENT = 4096


def fold_in_order(rows: DataFrame, key: str, order: str, columns: tuple[str, ...], start: Callable, step: Callable, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """One pass over each key's rows in order: state = start(); step(state, row) for each tuple of columns; then the dicts
    of finish(key, state). Keys are dealt by hash and sorted inside the partitions, where the sort may spill; rows are read
    as a stream, so a worker holds one batch and one state however many rows a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, state = [], None, None
        for batch in batches:
            table = [c.to_pylist() for c in batch.columns]
            for k, row in zip(table[0], zip(*table[1:], strict=True), strict=True):
                if state is None or k != held:
                    if state is not None:
                        out += finish(held, state)
                    held, state = k, start()
                step(state, row)
            if len(out) >= SENT:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            out += finish(held, state)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = rows.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    return dealt.select(key, *columns).mapInArrow(run, ddl)

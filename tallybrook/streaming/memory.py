"""Byte-bounded memories over an unbounded stream: state is the retained rows of each task.

Lateness is handled by version numbers, so there is no watermark. Within a micro-batch a task's events are applied in
order of pos; state stays within the byte budget whatever the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import POLICIES, Slots

_STATE = "keys array<string>, sources array<string>, versions array<int>, items array<string>, peak int"
_OUT = "task long, rows int, bytes int, peak int, state string"


def retain_stream(events: DataFrame, policy: str, budget: int) -> DataFrame:
    """task, rows, bytes, peak, state (compact JSON) after each micro-batch that brought events of the task."""
    rule = POLICIES[policy]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, peak = {}, 2
        if state.exists:
            keys, sources, versions, values, peak = state.get
            rows = {(k, s): (v, x) for k, s, v, x in zip(keys, sources, versions, values, strict=True)}
        slots = Slots(rule, budget, rows, peak)
        fresh = pd.concat(list(batches)).sort_values("pos")
        for e in fresh.itertuples():
            slots.put(e.op, e.key, e.source, int(e.version), None if pd.isna(e.value) else e.value)
        held = list(slots.rows.items())
        state.update(([k for (k, _), _ in held], [s for (_, s), _ in held], [v for _, (v, _) in held], [x for _, (_, x) in held], slots.peak))
        yield pd.DataFrame([(key[0], len(held), slots.size(), slots.peak, slots.text())], columns=["task", "rows", "bytes", "peak", "state"])

    return events.groupBy("task").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)

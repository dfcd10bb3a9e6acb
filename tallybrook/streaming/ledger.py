"""The life of model requests over a stream: reserve, progress, finish, within each route's limit of tokens.

Entries of a route's log are numbered by `pos`, from 1. They may come late, early and again: what comes early waits in
state until the entries before it have come, and what was applied is passed over. So the outcome is that of the log in
order, however it was cut into micro-batches, shuffled or replayed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "route string, pos long, op string, request long, outcome string, used long, held long, blocked boolean"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply(entry: tuple, totals: list, request: tuple | None) -> tuple[str, tuple | None]:
    """What an entry (op, amount; null: no usage known) does to totals [used, held, blocked, limit] and to its request
    (status, reserved): the outcome, and the request afterwards."""
    op, amount = entry
    if op == "reserve":
        if amount is None or amount <= 0:
            return "invalid reservation", request
        if request is not None:
            return "repeated request", request
        if totals[2] or totals[3] - totals[0] - totals[1] < amount:
            return "refused", request
        totals[1] += amount
        return "reserved", ("active", amount)
    if request is None:
        return "unknown request", request
    if op == "progress":
        return "progress", request
    status, reserved = request
    if status != "active":
        return "already settled", request
    if amount is None:
        return "unknown usage", ("unknown", reserved)  # the reservation stays held
    totals[0] += amount
    totals[1] -= reserved
    if amount > reserved:
        totals[2] = True
        return "overrun", ("settled", reserved)
    return "settled", ("settled", reserved)


class Lifecycle(StatefulProcessor):
    """One route: its totals, its requests, the next entry to apply and those that wait for it."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "used long, held long, blocked boolean, next long")
        self.requests = handle.getMapState("requests", "id long", "status string, reserved long")
        self.waiting = handle.getMapState("waiting", "pos long", "op string, request long, amount long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        used, held, blocked, upto = self.totals.get() if self.totals.exists() else (0, 0, False, 1)
        totals = [used, held, blocked, self.limit]
        early: dict[int, tuple] = {}
        for batch in rows:
            for pos, op, request, amount in zip(*(batch[c] for c in ("pos", "op", "request", "amount")), strict=True):
                if pos >= upto:
                    early[int(pos)] = (op, int(request), None if pd.isna(amount) else int(amount))
        known: dict[int, tuple | None] = {}
        touched, out = set(), []
        while upto in early or self.waiting.containsKey((upto,)):
            entry = early.pop(upto, None)
            if entry is None:
                op, request, amount = self.waiting.getValue((upto,))
                entry = (op, request, amount)
                self.waiting.removeKey((upto,))
            op, request, amount = entry
            if request not in known:
                known[request] = tuple(self.requests.getValue((request,))) if self.requests.containsKey((request,)) else None
            outcome, after = apply((op, amount), totals, known[request])
            if after != known[request]:
                known[request] = after
                touched.add(request)
            out.append((key[0], upto, op, request, outcome, totals[0], totals[1], totals[2]))
            upto += 1
        for pos, entry in early.items():
            self.waiting.updateValue((pos,), entry)
        for request in touched:
            self.requests.updateValue((request,), known[request])
        self.totals.update((totals[0], totals[1], totals[2], upto))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def lifecycle_stream(log: DataFrame, limit: int) -> DataFrame:
    """What each entry of a log (route, pos, op: reserve, progress or finish, request, amount) came to, once it could be
    applied. The stream needs the RocksDB state store, which this sets for the session's streams."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return log.groupBy("route").transformWithStateInPandas(statefulProcessor=Lifecycle(limit), outputStructType=_OUT, outputMode="Append", timeMode="None")

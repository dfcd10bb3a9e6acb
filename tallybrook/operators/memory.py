"""Bounded memories over ordered event streams: record-bounded maps and byte-bounded versioned slots.

Events are (task, pos, op, key, source, version, value) or, for record-bounded maps, (task, pos, key, value). The state
of a byte-bounded memory is a list of [key, source, version, value] in order of acceptance; a revocation leaves a row
without value. Its size is that of compact JSON, brackets and commas included. What a window expresses is a window; what
depends on earlier evictions is a fold over a task's ordered events: one pass over sorted partitions for all policies and
budgets at once, whose state is bounded however many events a task has; or, for tasks of moderate size, an expression
inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import fold_in_order

CAPACITY = 8
BUDGETS = (384, 768, 1536)
SOURCES = ("a", "b")


@dataclass(frozen=True)
class Policy:
    revoke: bool = True
    versions: bool = True
    collapse: bool = False
    both_sources: bool = False
    protect: bool = False


POLICIES = {
    "source": Policy(),
    "no_revoke": Policy(revoke=False),
    "no_version": Policy(versions=False),
    "latest": Policy(versions=False, collapse=True),
    "gated": Policy(both_sources=True),
    "protected": Policy(both_sources=True, protect=True),
}


class Slots:
    """Retained rows, oldest acceptance first, with their size as it changes."""

    def __init__(self, policy: Policy, budget: int, rows: dict | None = None, peak: int = 2):
        self.policy, self.budget, self.peak = policy, budget, peak
        self.rows: dict[tuple[str, str], tuple[int, str | None]] = rows or {}
        self.total = sum(self._bytes(k, v) for k, v in self.rows.items())

    @staticmethod
    def _bytes(slot: tuple[str, str], held: tuple[int, str | None]) -> int:
        """A row's bytes and one for the comma or bracket behind it."""
        value = 4 if held[1] is None else len(held[1].encode()) + 2
        return len(slot[0].encode()) + len(slot[1]) + len(str(held[0])) + value + 10

    def size(self) -> int:
        return self.total + 1 if self.rows else 2

    def text(self) -> str:
        said = lambda v: "null" if v is None else f'"{v}"'
        return "[" + ",".join(f'["{k}","{s}",{v},{said(x)}]' for (k, s), (v, x) in self.rows.items()) + "]"

    def _pop(self, slot: tuple[str, str]) -> None:
        self.total -= self._bytes(slot, self.rows.pop(slot))

    def put(self, op: str, key: str, source: str, version: int, value: str | None) -> None:
        p = self.policy
        slot = (key, "*" if p.collapse else source)
        old = self.rows.get(slot)
        if op == "R" and not p.revoke:
            return
        if old is not None:
            behind = version < old[0]
            if (behind and (p.versions or op == "R")) or (p.versions and op == "P" and version == old[0] and old[1] is None):
                return
            self._pop(slot)
        self.rows[slot] = held = (version, value if op == "P" else None)
        self.total += self._bytes(slot, held)
        while self.total + 1 > self.budget and self.rows:
            live = (k for k, v in self.rows.items() if v[1] is not None) if p.protect else iter(())
            self._pop(next(live, None) or next(iter(self.rows)))
        self.peak = max(self.peak, self.size())


# ------------------------------------------------ record-bounded maps
def recent(events: DataFrame, capacity: int = CAPACITY, keyed_only: bool = False) -> DataFrame:
    """task, key, value, pos retained by the last events (or the last keyed ones); the newest of each key."""
    e = events.filter("key IS NOT NULL") if keyed_only else events
    last = e.withColumn("rn", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("pos")))).filter(F.col("rn") <= capacity)
    return last.filter("key IS NOT NULL").groupBy("task", "key").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"))


def keyed(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Least recently written key goes first: equal to the newest values of the most recently written keys."""
    newest = events.filter("key IS NOT NULL").groupBy("task", "key").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"))
    return newest.withColumn("rn", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("pos")))).filter(F.col("rn") <= capacity).drop("rn")


def _listed(events: DataFrame, *columns: str) -> DataFrame:
    return events.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("events"))


_KEPT = pa.schema([("task", pa.int64()), ("key", pa.string()), ("value", pa.int64())])


def bounded_map(events: DataFrame, keep_first: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """First in, first out (an overwrite keeps its place); or keep_first: the first value stays while the key is resident, a write refreshes it."""

    def step(held: dict, event: tuple) -> None:
        key, value = event
        if keep_first and key in held:
            held[key] = held.pop(key)
        else:
            held[key] = value
        if len(held) > capacity:
            del held[next(iter(held))]

    finish = lambda task, held: [{"task": task, "key": k, "value": v} for k, v in held.items()]
    keyed_ = events.filter("key IS NOT NULL").select(F.col("task").cast("long").alias("task"), "pos", "key", F.col("value").cast("long").alias("value"))
    return fold_in_order(keyed_, "task", "pos", ("key", "value"), dict, step, finish, _KEPT, "task long, key string, value long")


def truth(events: DataFrame) -> DataFrame:
    return events.filter("key IS NOT NULL").groupBy("task", "key").agg(F.max_by("value", "pos").alias("expected"))


# ------------------------------------------------ byte-bounded versioned slots
def row_bytes(key: Column, source: Column, version: Column, value: Column, op: Column | None = None) -> Column:
    """Bytes of a row as compact JSON (keys and values without characters that need escapes)."""
    n = F.octet_length(key) + F.octet_length(source) + F.length(version.cast("string")) + F.coalesce(F.octet_length(value) + 2, F.lit(4)) + 9
    return n + F.octet_length(op) + 3 if op is not None else n


_RETAINED = pa.schema([
    ("policy", pa.string()), ("task", pa.int64()), ("budget", pa.int32()),
    ("rows", pa.list_(pa.struct([("key", pa.string()), ("source", pa.string()), ("version", pa.int32()), ("value", pa.string())]))), ("bytes", pa.int32()), ("peak", pa.int32()),
])
_ROW = "struct<pos:bigint,key:string,source:string,version:int,value:string,size:int>"


_STATE = f"struct<rows:array<{_ROW}>,total:int,peak:int>"


def _size(total: Column) -> Column:
    """Bytes of a list from the sum of its rows' sizes, commas included."""
    return F.when(total == 0, F.lit(2)).otherwise(total + 1)


def _drop(order: Column, total: Column, budget: Column) -> Column:
    """How many of the first rows have to go before the rest fits, and the sum of the sizes that are left."""
    start = F.struct(total.alias("total"), F.lit(0).alias("gone"))
    step = lambda a, r: F.when(_size(a["total"]) > budget, F.struct((a["total"] - r["size"] - 1).alias("total"), (a["gone"] + 1).alias("gone"))).otherwise(a)
    return F.aggregate(order, start, step)


def _rest(rows: Column, gone: Column) -> Column:
    return F.slice(rows, F.greatest(gone, F.lit(0)) + 1, F.greatest(F.size(rows), F.lit(1)))


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _evict(rows: Column, total: Column, peak: Column, budget: Column, protect: bool) -> Column:
    def cut(order: Column, rest) -> Column:
        return _bind(_drop(order, total, budget), lambda d: F.struct(rest(d["gone"]).alias("rows"), d["total"].alias("total"), F.greatest(peak, _size(d["total"])).alias("peak")))

    if not protect:
        return cut(rows, lambda gone: _rest(rows, gone))
    live, dead = F.filter(rows, lambda x: x["value"].isNotNull()), F.filter(rows, lambda x: x["value"].isNull())
    return cut(F.concat(live, dead), lambda gone: F.array_sort(F.concat(_rest(live, gone), _rest(dead, gone - F.size(live)))))


def _accept(a: Column, e: Column, p: Policy, budget: Column) -> Column:
    """The state after an event: rows, the sum of their sizes, and the largest size so far."""
    source = F.lit("*") if p.collapse else e["source"]
    same = lambda r: (r["key"] == e["key"]) & (r["source"] == source)

    def given(old: Column) -> Column:
        refused = old.isNotNull() & (e["op"] == "R") & (e["version"] < old["version"])
        if p.versions:
            refused |= old.isNotNull() & ((e["version"] < old["version"]) | ((e["version"] == old["version"]) & old["value"].isNull() & (e["op"] == "P")))
        if not p.revoke:
            refused |= e["op"] == "R"
        value = F.when(e["op"] == "P", e["value"])
        size = row_bytes(e["key"], source, e["version"], value).cast("int")
        new = F.struct(e["pos"].alias("pos"), e["key"].alias("key"), source.alias("source"), e["version"].alias("version"), value.alias("value"), size.alias("size")).cast(_ROW)
        others = F.when(old.isNull(), a["rows"]).otherwise(F.filter(a["rows"], lambda r: ~same(r)))
        grown = F.struct(F.concat(others, F.array(new)).alias("rows"), (a["total"] + size - F.coalesce(old["size"], F.lit(-1))).cast("int").alias("total"))

        def fit(g: Column) -> Column:
            # only a list beyond its budget is walked
            whole = F.struct(g["rows"].alias("rows"), g["total"].alias("total"), F.greatest(a["peak"], _size(g["total"])).alias("peak"))
            return F.when(_size(g["total"]) <= budget, whole.cast(_STATE)).otherwise(_evict(g["rows"], g["total"], a["peak"], budget, p.protect).cast(_STATE))

        return F.when(F.coalesce(refused, F.lit(False)), a).otherwise(_bind(grown, fit))

    return _bind(F.get(F.filter(a["rows"], same), F.lit(0)), given)


def retain(events: DataFrame, policy: str, budgets=BUDGETS) -> DataFrame:
    """task, budget, rows, bytes, peak: the memory after all events, and its largest size after any."""
    p = POLICIES[policy]
    listed = _listed(events, "op", "key", "source", "version", "value").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    # tasks with budgets are dealt anew, so that folds of one task don't wait for each other
    listed = listed.repartition("task", "budget")
    start = F.struct(F.array().cast(f"array<{_ROW}>").alias("rows"), F.lit(0).alias("total"), F.lit(2).alias("peak")).cast(_STATE)
    done = listed.withColumn("s", F.aggregate("events", start, lambda a, e: _accept(a, e, p, F.col("budget"))))
    return done.select("task", "budget", F.col("s.rows").alias("rows"), _size(F.col("s.total")).alias("bytes"), F.col("s.peak").alias("peak"))


def retain_all(events: DataFrame, policies=tuple(POLICIES), budgets=BUDGETS) -> DataFrame:
    """policy, task, budget, rows, bytes, peak: the same for all policies and budgets in one pass over each task's events."""
    rules = {n: POLICIES[n] for n in policies}

    def step(slots: dict, event: tuple) -> None:
        for s in slots.values():
            s.put(*event)

    def finish(task: int, slots: dict) -> list[dict]:
        listed = lambda s: [{"key": k, "source": w, "version": v, "value": x} for (k, w), (v, x) in s.rows.items()]
        return [{"policy": n, "task": task, "budget": b, "rows": listed(s), "bytes": s.size(), "peak": s.peak} for (n, b), s in slots.items()]

    kind = "array<struct<key:string,source:string,version:int,value:string>>"
    start = lambda: {(n, b): Slots(rule, b) for n, rule in rules.items() for b in budgets}
    e = events.withColumn("task", F.col("task").cast("long"))
    return fold_in_order(e, "task", "pos", ("op", "key", "source", "version", "value"), start, step, finish, _RETAINED, f"policy string, task long, budget int, rows {kind}, bytes int, peak int")


def asked(events: DataFrame) -> DataFrame:
    """task, key: one question for every key that a task has seen."""
    return events.select("task", "key").distinct()


def read(state: DataFrame, questions: DataFrame, policy: str | None = None) -> DataFrame:
    """task, budget, key, predicted, bytes, peak (and policy, if state has the column)."""
    gated = F.col("policy").isin([n for n, p in POLICIES.items() if p.both_sources]) if policy is None else F.lit(POLICIES[policy].both_sources)
    j = state.join(questions, "task").withColumn("m", F.filter("rows", lambda r: r["key"] == F.col("key")))
    abstain = (F.size("m") == 0) | (gated & (F.size(F.array_distinct(F.col("m")["source"])) < len(SOURCES)))
    own = ["policy"] if policy is None else []
    return j.select(*own, "task", "budget", "key", F.when(abstain, "ABSTAIN").otherwise(T.answer(F.col("m")["value"])).alias("predicted"), "bytes", "peak")


def oracle(events: DataFrame, by=("task",)) -> DataFrame:
    """by, key, expected, active, history: the batch rule. A source's newest version counts, unless it was revoked."""
    per = events.withColumn("top", F.max("version").over(Window.partitionBy(*by, "key", "source")))
    at_top = F.col("version") == F.col("top")
    source = per.groupBy(*by, "key", "source").agg(
        F.bool_or(at_top & (F.col("op") == "R")).alias("revoked"),
        F.max_by(F.when(at_top & (F.col("op") == "P"), F.col("value")), F.when(at_top & (F.col("op") == "P"), F.col("pos"))).alias("value"),
        F.collect_set(F.when(F.col("op") == "P", F.col("value"))).alias("puts"),
    )
    value = F.when(~F.col("revoked"), F.col("value"))
    keys = source.groupBy(*by, "key").agg(F.collect_list(value).alias("values"), F.array_distinct(F.flatten(F.collect_list("puts"))).alias("history"))
    return keys.select(*by, "key", T.answer(F.col("values")).alias("expected"), F.array_distinct("values").alias("active"), "history")


def window_events(events: DataFrame, budgets=BUDGETS) -> DataFrame:
    """The longest suffix of raw events that fits each budget, with its size; a pure window."""
    size = row_bytes(F.col("key"), F.col("source"), F.col("version"), F.when(F.col("op") == "P", F.col("value")), F.col("op"))
    back = Window.partitionBy("task").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    sized = events.withColumn("total", F.sum(size + 1).over(back) + 1)
    return sized.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).filter(F.col("total") <= F.col("budget"))


def read_window(events: DataFrame, budgets=BUDGETS) -> DataFrame:
    """task, budget, key, predicted of the raw-event window: the batch rule on the suffix."""
    suffix = window_events(events, budgets)
    said = oracle(suffix, ("task", "budget")).select("task", "budget", "key", F.col("expected").alias("said"))
    frame = asked(events).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return frame.join(said, ["task", "budget", "key"], "left").select("task", "budget", "key", F.coalesce("said", F.lit("ABSTAIN")).alias("predicted"))


def metrics(predictions: DataFrame, keys) -> DataFrame:
    """Rates of predictions (expected, predicted, stale, bytes, peak) by keys; conditional rates are 0 without cases."""
    hit = F.col("predicted") == F.col("expected")
    unknown, conflict = F.col("expected") == "UNKNOWN", F.col("expected") == "CONFLICT"
    concrete = ~unknown & ~conflict
    rate = lambda case, hits: F.sum((case & hits).cast("int")) / F.greatest(F.lit(1), F.sum(case.cast("int")))
    every = F.lit(True)
    return predictions.groupBy(*keys).agg(
        rate(every, hit).alias("accuracy"), rate(every, F.col("stale")).alias("stale_rate"), rate(every, F.col("predicted") == "ABSTAIN").alias("abstain_rate"),
        rate(concrete, hit).alias("concrete_recall"), rate(unknown, hit).alias("unknown_accuracy"), rate(conflict, hit).alias("conflict_accuracy"),
        rate(conflict, ~F.col("predicted").isin("UNKNOWN", "CONFLICT", "ABSTAIN")).alias("false_concrete_conflict_rate"),
        F.avg("bytes").alias("mean_bytes"), F.max("peak").alias("max_bytes"), F.count("*").alias("total"),
    )


def judged(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """predictions with expected, and stale: a value that was put once but is not active."""
    j = predictions.join(oracle(events), ["task", "key"])
    return j.withColumn("stale", F.array_contains("history", F.col("predicted")) & ~F.array_contains("active", F.col("predicted")))

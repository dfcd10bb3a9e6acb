"""Synthetic event streams for tasks that a table names, from digests: any partition makes its own rows, and every rerun
makes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of versioned traces.
FAMILIES = ("steady", "update", "revoke", "conflict", "resolve", "replay")


def _unit(seed: int, *parts) -> Column:
    """A number in [0, 1) for each combination of parts: the first 40 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(p if isinstance(p, Column) else F.col(p).cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") / float(1 << 40)


def _grid(tasks: DataFrame, per: int) -> DataFrame:
    """Each task with the places 0 to per - 1."""
    return tasks.select(F.col("task").cast("long").alias("task")).distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("pos", F.col("pos").cast("long"))


def keyed_episodes(tasks: DataFrame, seed: int, events: int = 72, share: float = 0.65, keys: int = 16) -> DataFrame:
    """task, pos, key (null: a distractor), value: each event has a key with probability `share`."""
    grid = _grid(tasks, events)
    key = F.concat(F.lit("k"), F.floor(_unit(seed, "task", "pos", F.lit("key")) * keys).cast("string"))
    is_keyed = _unit(seed, "task", "pos", F.lit("kind")) < share
    return grid.select("task", "pos", F.when(is_keyed, key).alias("key"), F.when(is_keyed, F.floor(_unit(seed, "task", "pos", F.lit("value")) * 10_000)).alias("value"))


def versioned_traces(tasks: DataFrame, seed: int, keys: int = 12, background: int = 64) -> DataFrame:
    """task, family, pos, op, key, source, version, value. Both sources first agree on every key; then the family's own
    transition happens to k0 among background puts and (16 %) revocations of other keys."""
    per = 2 * keys + background + 4
    grid = _grid(tasks, per)
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("task") % len(FAMILIES) + 1).cast("int"))
    opening, late = F.col("pos") < 2 * keys, F.col("pos") - (2 * keys + background)
    u = lambda name: _unit(seed, "task", "pos", F.lit(name))
    of = lambda i, s, o, v, x: F.struct(F.lit("k0").alias("key"), F.lit(s).alias("source"), F.lit(o).alias("op"), F.lit(v).alias("version"), F.lit(x).alias("value"))
    moves = {
        "steady": [], "update": [("a", "P", 2, "B"), ("b", "P", 2, "B")], "revoke": [("a", "R", 1, None), ("b", "R", 1, None)], "conflict": [("a", "P", 2, "B")],
        "resolve": [("a", "P", 2, "B"), ("b", "P", 2, "B")], "replay": [("a", "P", 2, "B"), ("b", "P", 2, "B"), ("a", "P", 1, "A"), ("b", "P", 1, "A")],
    }
    moved = F.lit(None)
    for name, steps in moves.items():
        for i, (s, o, v, x) in enumerate(steps):
            moved = F.when((family == name) & (late == i), of(i, s, o, v, x)).otherwise(moved)
    first = F.struct(F.concat(F.lit("k"), F.expr("pos DIV 2").cast("string")).alias("key"), F.when(F.col("pos") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("P").alias("op"), F.lit(1).alias("version"), F.lit("A").alias("value"))
    other = F.concat(F.lit("k"), (F.floor(u("key") * (keys - 1)) + 1).cast("string"))
    gone = u("op") < 0.16
    noise = F.struct(other.alias("key"), F.when(u("source") < 0.5, "a").otherwise("b").alias("source"), F.when(gone, "R").otherwise("P").alias("op"), (F.floor(u("version") * 4) + 1).cast("int").alias("version"), F.when(~gone, F.concat(F.lit("v"), F.col("pos").cast("string"))).alias("value"))
    e = grid.withColumn("family", family).withColumn("e", F.when(opening, first).when(late < 0, noise).otherwise(moved)).filter("e IS NOT NULL")
    return e.select("task", "family", "pos", "e.op", "e.key", "e.source", "e.version", "e.value")

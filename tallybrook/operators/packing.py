"""Packing ranked documents under byte budgets, and scoring what was packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BUDGETS = (1024, 2048, 4096, 8192, 16384)


def _chosen(ranked: Column, budget: Column) -> Column:
    """doc_i of each document that still fits, in ranked order; one that doesn't is skipped."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, d: Column) -> Column:
        fits = a["used"] + d["bytes"] <= budget
        return F.struct(F.when(fits, a["used"] + d["bytes"]).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["ids"], d["doc_i"])).otherwise(a["ids"]).alias("ids"))

    return F.aggregate(ranked, start, step)["ids"]


def _pack(listed: DataFrame, keys: list[str], budgets, chosen) -> DataFrame:
    p = listed.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).withColumn("selected", F.array_sort(chosen(F.col("docs"), F.col("budget"))))
    picked = F.transform(F.col("selected"), lambda i: F.element_at(F.col("by_place"), i + 1))
    p = p.withColumn("picked", picked)
    return p.select(
        *keys, "budget", "selected", F.array_join(F.col("picked")["serialized"], "").alias("context"),
        F.aggregate(F.col("picked")["bytes"], F.lit(0), lambda a, b: a + b).alias("bytes"), F.array_sort(F.array_distinct(F.col("picked")["session"])).alias("sessions"),
    )


def _listed(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """A scenario's documents in ranked order (sizes only), and by place."""
    return ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", F.col("doc_i").cast("int").alias("doc_i"), F.col("bytes").cast("int").alias("bytes")))).alias("docs"),
        F.array_sort(F.collect_list(F.struct("doc_i", F.col("bytes").cast("int").alias("bytes"), "session", "serialized"))).alias("by_place"),
    )


def pack_greedy(ranked: DataFrame, budgets=BUDGETS, keys=("uid", "dim")) -> DataFrame:
    """keys, budget, selected, context, bytes, sessions; skips what doesn't fit and goes on."""
    return _pack(_listed(ranked, [*keys]), [*keys], budgets, _chosen)


def pack_stop(ranked: DataFrame, budgets=BUDGETS, keys=("uid", "dim")) -> DataFrame:
    """The same, but ends with the first document that doesn't fit: a running sum."""
    keys = [*keys]
    run = Window.partitionBy(*keys).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.withColumn("end", F.sum("bytes").over(run)).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    fits = F.col("end") <= F.col("budget")
    packed = summed.groupBy(*keys, "budget").agg(F.array_sort(F.collect_list(F.when(fits, F.struct(F.col("doc_i").cast("int").alias("doc_i"), F.col("bytes").cast("int").alias("bytes"), "session", "serialized")))).alias("picked"))
    return packed.select(
        *keys, "budget", F.col("picked")["doc_i"].alias("selected"), F.array_join(F.col("picked")["serialized"], "").alias("context"),
        F.aggregate(F.col("picked")["bytes"], F.lit(0), lambda a, b: a + b).alias("bytes"), F.array_sort(F.array_distinct(F.col("picked")["session"])).alias("sessions"),
    )


def pack_excluding(ranked: DataFrame, excluded: DataFrame, budgets, keys=("uid", "dim")) -> DataFrame:
    """Greedy packing without the documents (uid, doc_i) of excluded."""
    listed = _listed(ranked, [*keys])
    out = excluded.groupBy("uid").agg(F.collect_set("doc_i").alias("out"))
    j = listed.join(out, "uid", "left").withColumn("docs", F.filter("docs", lambda d: ~F.coalesce(F.array_contains("out", d["doc_i"]), F.lit(False))))
    return _pack(j, [*keys], budgets, _chosen)


def score(packed: DataFrame, gold: DataFrame, odd: bool = True) -> DataFrame:
    """packed with 0/1 flags: the new and old statement stand in the context, and its session is among those packed.
    odd=False: no text needs Python to be normalised."""
    flag = lambda c: c.cast("int")
    said = gold.select("uid", "type", "update_session", T.normalize(F.col("m_new"), odd).alias("new_n"), T.normalize(F.col("m_old"), odd).alias("old_n"))
    said = said.withColumn("new_w", F.when(F.size(T.words_of(F.col("new_n"))) > 0, T.spaced(F.col("new_n"))))
    keys = [c for c in packed.columns if c not in ("selected", "context", "bytes", "sessions")]
    # a context is normalised once, for three questions
    j = packed.withColumn("context_n", T.normalize(F.col("context"), odd)).join(said, "uid")
    return j.select(
        *keys, "type", flag(F.contains("context_n", "new_n")).alias("new"), flag(F.contains("context_n", "old_n")).alias("old"),
        flag(F.coalesce(F.contains(T.spaced(F.col("context_n")), F.col("new_w")), F.lit(False))).alias("token_new"), flag(F.array_contains("sessions", F.col("update_session"))).alias("update_session"), "bytes",
    )

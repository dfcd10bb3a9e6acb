"""Experiment grids, candidate search, token ledgers, feeds, manifests and tabular scores over records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import identity
from ..sources.shared import cut, discard
from .folds import fold_in_order


# ------------------------------------------------ grids and search
def job_grid(methods: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every method with every seed; both are short parameter lists."""
    return methods.crossJoin(seeds)


def completeness(grid: DataFrame, results: DataFrame) -> DataFrame:
    return grid.join(results.select("method", "seed", F.lit(True).alias("done")), ["method", "seed"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def valid_results(results: DataFrame) -> DataFrame:
    """Results with a finite metric."""
    return results.filter(F.col("metric").isNotNull() & ~F.isnan("metric") & (F.abs("metric") < F.lit(float("inf"))))


def summary(results: DataFrame, baseline: str, strict: bool = False) -> DataFrame:
    """method, n, mean, sd, and the mean and sd of the paired difference from the baseline (seed by seed). strict: fails if
    a method lacks a seed that another one has, or has one twice."""
    if strict:
        per = results.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("seed").alias("seeds"))
        seeds = results.select("seed").distinct().count()
        if short := [r["method"] for r in per.filter((F.col("n") != seeds) | (F.col("seeds") != seeds)).limit(20).collect()]:
            raise ValueError(f"the grid is incomplete for {short}")
    base = F.max(F.when(F.col("method") == baseline, F.col("metric"))).over(Window.partitionBy("seed"))
    r = results.withColumn("delta", F.col("metric") - base)
    return r.groupBy("method").agg(F.count("*").alias("n"), F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("sd"), F.avg("delta").alias("delta_mean"), F.stddev_samp("delta").alias("delta_sd"))


def same_data(results: DataFrame) -> DataFrame:
    """seed, ok: the seed's digests are all null or all one."""
    known, kinds = F.count("dataset_sha256"), F.count_distinct("dataset_sha256")
    return results.groupBy("seed").agg(((known == 0) | ((known == F.count("*")) & (kinds == 1))).alias("ok"))


def search(scores: DataFrame, baseline_score: Column, threshold: float, max_trials: int, patience: int, maximize: bool = True) -> DataFrame:
    """Trials in registered order until trials or patience run out; a candidate is kept if it beats the incumbent by more
    than the threshold. scores: place, candidate, score; one list of candidates, folded in order."""
    sign = 1.0 if maximize else -1.0
    start = F.struct(baseline_score.alias("best"), F.lit(None).cast("string").alias("incumbent"), F.lit(0).alias("since"), F.array().cast("array<struct<place:int,candidate:string,score:double,previous:double,accepted:boolean>>").alias("trials"))

    def step(a: Column, c: Column) -> Column:
        stop = (F.size(a["trials"]) >= max_trials) | ((F.size(a["trials"]) >= patience) & (a["since"] >= patience))
        better = F.lit(sign) * (c["score"] - a["best"]) > threshold
        trial = F.struct(c["place"].alias("place"), c["candidate"].alias("candidate"), c["score"].alias("score"), a["best"].alias("previous"), better.alias("accepted"))
        new = F.struct(F.when(better, c["score"]).otherwise(a["best"]).alias("best"), F.when(better, c["candidate"]).otherwise(a["incumbent"]).alias("incumbent"), F.when(better, 0).otherwise(a["since"] + 1).alias("since"), F.array_append(a["trials"], trial).alias("trials"))
        return F.when(stop, a).otherwise(new)

    listed = scores.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "candidate", "score"))).alias("c"))
    return listed.select(F.explode(F.aggregate("c", start, step)["trials"]).alias("t")).select("t.*")


# ------------------------------------------------ ledgers
def rollup(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Per alias of models: settled usage, reservations still held, what remains of the limit, and states."""
    settled = F.col("status") == "settled"
    used = lambda c: F.sum(F.when(settled, F.col(c)).otherwise(0))
    per = requests.groupBy("alias").agg(
        used("total_tokens").alias("reported"), used("input_tokens").alias("input"), used("output_tokens").alias("output"), used("cached_input_tokens").alias("cached"), used("reasoning_output_tokens").alias("reasoning"),
        F.sum(F.when(settled, 0).otherwise(F.col("reserved_tokens"))).alias("held"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("active", "settled", "unknown")),
        F.max((settled & (F.col("total_tokens") > F.col("reserved_tokens"))).cast("int")).alias("blocked"),
    )
    j = models.join(per, "alias", "left").na.fill(0)
    return j.withColumn("remaining", F.greatest(F.lit(0), F.col("limit") - F.col("reported") - F.col("held")))


_ADMITTED = pa.schema([("key", pa.int64()), ("admitted", pa.int32()), ("used", pa.float64()), ("refused", pa.int32())])


def admission(requests: DataFrame, most: int, seconds: float, key: str = "task") -> DataFrame:
    """Per key, in order of pos: a request is admitted while fewer than `most` were and its seconds still fit. Nothing is refunded."""

    def step(a: dict, request: tuple) -> None:
        if a["admitted"] < most and a["used"] + request[0] <= seconds:
            a["admitted"] += 1
            a["used"] += request[0]
        else:
            a["refused"] += 1

    start = lambda: {"admitted": 0, "used": 0.0, "refused": 0}
    r = requests.select(F.col(key).cast("long").alias("key"), "pos", F.col("seconds").cast("double").alias("seconds"))
    folded = fold_in_order(r, "key", "pos", ("seconds",), start, step, lambda k, a: [{"key": k, **a}], _ADMITTED, "key long, admitted int, used double, refused int")
    return folded.withColumnRenamed("key", key)


#: What may follow a state of a request; nothing follows a finished one.
FOLLOWS = {"active": ("active", "settled", "unknown")}


def ledger_faults(log: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Entries of an append-only log (key, order, status) that can't follow the one before: a request that was settled, or
    whose usage is unknown, is finished for good."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(order))
    legal = F.create_map(*(x for s, after in FOLLOWS.items() for x in (F.lit(s), F.array(*map(F.lit, after)))))
    fits = F.col("before").isNull() | F.coalesce(F.array_contains(F.try_element_at(legal, F.col("before")), F.col("status")), F.lit(False))
    return log.withColumn("before", before).filter(~fits).select(key, order, "before", "status")


def first_per_key(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """key, and a list of its first n values of `order`."""
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("rn") <= n)
    return first.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("first"))


def cached_requests(requests: DataFrame, key: list[str]) -> DataFrame:
    """requests with `reused`: an earlier request of the same content settled. requests: pos, status and key columns. Of
    each content only the first settled place is looked up, so a content that all ask for is no group of its own."""
    content = F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in key)), 256)
    first = requests.filter("status = 'settled'").groupBy(content.alias("content")).agg(F.min("pos").alias("first"))
    joined = requests.withColumn("content", content).join(first, "content", "left")
    return joined.select(*requests.columns, F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("reused"))


# ------------------------------------------------ feeds and manifests
def newest(feed: DataFrame, n: int = 80) -> DataFrame:
    """The newest n by time, ties by larger id: a bounded top-n, not a sort."""
    return feed.orderBy(F.desc("time"), F.desc("id"), F.desc("event"), F.desc("owner")).limit(n)


def tail_per_key(rows: DataFrame, key: str, order: str, n: int = 30) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("rn") <= n)


def manifest(rows: DataFrame, path: str, content: str) -> DataFrame:
    return rows.select(F.col(path).cast("string").alias("path"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def manifest_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that are missing, changed, unlisted, or recorded with a malformed digest."""
    a = recorded.select("path", F.col("bytes").alias("b1"), F.col("sha256").alias("s1"))
    b = current.select("path", F.col("bytes").alias("b2"), F.col("sha256").alias("s2"))
    j = a.join(b, "path", "full_outer")
    state = (
        F.when(F.col("s1").isNull(), "unlisted").when(~F.col("s1").rlike("^[0-9a-f]{64}$"), "malformed").when(F.col("s2").isNull(), "missing")
        .when((F.col("b1") != F.col("b2")) | (F.col("s1") != F.col("s2")), "changed").otherwise("ok")
    )
    return j.select("path", state.alias("state"))


def safe_path(path: Column) -> Column:
    """Relative, without a parent step."""
    return ~path.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)") & (path != "")


def claim_gate(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with the number of its references that no evidence row matches; open if none is missing."""
    refs = claims.select("claim", F.explode("refs").alias("path"))
    missing = refs.join(evidence.select("path"), "path", "left_anti").groupBy("claim").agg(F.count("*").alias("missing"))
    return claims.select("claim", F.size("refs").alias("n_refs")).join(missing, "claim", "left").select("claim", "n_refs", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce(F.col("missing") == 0, F.lit(True)).alias("open"))


def unique_blobs(rows: DataFrame) -> DataFrame:
    """One row for each digest: the first path, and how many had it."""
    return rows.groupBy("sha256").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"), F.count("*").alias("copies"))


# ------------------------------------------------ samples and tabular scores
def numbered_within(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """rows with `place`: the number, from 1, of each row within its key. Keys of any size are sorted by ranges over all
    partitions; only the counts of keys in partitions meet."""
    dealt = cut(rows.withColumn("by", order).repartitionByRange(F.col(key).asc_nulls_first(), F.col("by")).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(key, "part").count()
    first = counts.select(F.col(key).alias("of"), "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy(key, "part").orderBy("by"))
    placed = dealt.withColumn("within", within).join(first, (dealt["part"] == first["part"]) & F.col(key).eqNullSafe(F.col("of")))
    return placed.select(*rows.columns, (F.col("first") + F.col("within")).alias("place"))


def tree_identity(rows: DataFrame, order: tuple[str, ...], fan: int = 100) -> DataFrame:
    """n, sha256: one identity of all rows, in the order of these columns, whatever order they are read in. The leaves are
    the identities of rows; each `fan` digests in a row make one of the next level, until one is left. So no group holds
    more than `fan` digests. Without rows there is none."""
    leaf = rows.select(F.struct(*order).alias("o"), identity(F.struct(*rows.columns), rows.schema).alias("digest"), F.lit(0).alias("all"))
    numbered = numbered_within(leaf, "all", F.struct("o", "digest"))  # equal places by digest
    level = cut(numbered.select((F.col("place") - 1).alias("place"), "digest"))
    n = left = level.count()
    while left > 1:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        above = cut(level.groupBy(F.floor(F.col("place") / fan).alias("place")).agg(F.sha2(F.array_join(listed, ""), 256).alias("digest")))
        discard(level)
        level, left = above, -(-left // fan)
    return level.select(F.lit(n).cast("long").alias("n"), F.col("digest").alias("sha256"))


def hash_order(seed: Column | str, id_col: str) -> Column:
    return F.sha2(F.concat(F.lit(seed) if isinstance(seed, str) else seed, F.lit(":"), F.col(id_col).cast("string")), 256)


def stratified(rows: DataFrame, stratum: str, id_col: str, k: int, seed: str, strict: bool = False) -> DataFrame:
    """k rows of each stratum, in the order of a digest of seed and id. strict: fails if a stratum has fewer."""
    if strict and (short := [r[0] for r in rows.groupBy(stratum).count().filter(F.col("count") < k).limit(20).collect()]):
        raise ValueError(f"fewer than {k} rows in {short}")
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, id_col), id_col)
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def threshold_accuracy(rows: DataFrame, parameters) -> DataFrame:
    """Share of rows whose x reaches the parameter exactly when y is set. rows: x, y."""
    p = rows.withColumn("p", F.explode(F.array(*map(F.lit, parameters))))
    return p.groupBy("p").agg(F.avg(((F.col("x") >= F.col("p")) == (F.col("y") != 0)).cast("int")).alias("score"), F.count("*").alias("n"))


def squared_error(rows: DataFrame, parameters) -> DataFrame:
    p = rows.withColumn("p", F.explode(F.array(*map(F.lit, parameters))))
    return p.groupBy("p").agg(F.avg(F.pow(F.col("p") * F.col("x") - F.col("y"), 2)).alias("score"), F.count("*").alias("n"))


def compare(baseline: DataFrame, candidate: DataFrame, keys: list[str], min_gain: float, maximize: bool = True) -> DataFrame:
    """gain of candidate over baseline for rows that agree on keys; improved only beyond min_gain."""
    j = baseline.select(*keys, F.col("score").alias("before")).join(candidate.select(*keys, F.col("score").alias("after")), keys)
    gain = (F.col("after") - F.col("before")) * (1.0 if maximize else -1.0)
    return j.withColumn("gain", gain).withColumn("improved", gain > min_gain)

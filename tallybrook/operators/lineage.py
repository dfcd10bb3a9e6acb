"""Stage graphs: order, ancestors, signatures, staleness, blockers, what may run, revision, reviews and reuse.

Stages are (stage, project, place, adapter, role, review, split, status, attempts, max_attempts, paid) and edges (stage,
needs), of any depth. What changes below a stage is found by walking blocks of stages, not by a closure (`downstream`);
only `ancestors`, whose result is the closure itself, makes all pairs, where they are found by walks, too."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from ..functions.canonical import identity
from ..sources.shared import cut, discard

#: Stages that one task walks at once.
BLOCK = 20_000
#: Pairs of a stage and a door that one task walks from, and pairs that are sent at once.
PART, SENT = 100_000, 50_000


def _walk(rows: pa.Table) -> pa.Table:
    """The stages that a block's seeds reach along its edges, those already reached left out."""
    kinds, froms, tos = (rows[c].to_pylist() for c in ("kind", "a", "b"))
    below, todo, known = defaultdict(list), [], set()
    for kind, a, b in zip(kinds, froms, tos, strict=True):
        if kind == "edge":
            below[a].append(b)
        elif kind == "seed":
            todo.append(a)
        else:
            known.add(a)
    found = []
    while todo:
        stage = todo.pop()
        if stage not in known:
            known.add(stage)
            found.append(stage)
            todo += below.get(stage, ())
    block = rows["block"][0].as_py()
    return pa.table({"block": pa.array([block] * len(found), rows.schema.field("block").type), "stage": pa.array(found, rows.schema.field("a").type)})


def downstream(stages: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stages that are reached: those with `seed`, and each that `carries` and needs a reached one. stages: stage,
    project, place, seed, carries.

    Stages are sorted by project and place and cut into blocks of about `block`. A task walks the edges inside its block
    once; edges that leave a block carry newly reached stages to the next round, in which only the blocks they lead to are
    walked again, from there on. So rounds grow with the blocks of the longest project, not with its depth, and a task
    holds the edges of one block."""
    kind = stages.schema["stage"].dataType.simpleString()
    n = stages.count()
    dealt = stages.repartitionByRange(max(1, math.ceil(n / block)), "project", "place", "stage")
    placed = cut(dealt.select("stage", (F.col("seed") & F.col("carries")).alias("seed"), "carries", F.spark_partition_id().alias("block")))
    into = placed.filter("carries").select("stage", F.col("block").alias("block"))
    out_of = placed.select(F.col("stage").alias("needs"), F.col("block").alias("from_block"))
    lines = cut(edges.distinct().join(into, "stage").join(out_of, "needs").select("block", "from_block", "needs", "stage"))
    inner = lines.filter("block = from_block").select("block", F.lit("edge").alias("kind"), F.col("needs").alias("a"), F.col("stage").alias("b"))
    across = lines.filter("block <> from_block").select("block", "needs", "stage")

    def walked(seeds: DataFrame, known: DataFrame | None) -> DataFrame:
        none = F.lit(None).cast(kind).alias("b")
        start = seeds.select("block", F.lit("seed").alias("kind"), F.col("stage").alias("a"), none)
        active = seeds.select("block").distinct()
        rows = start.union(inner.join(active, "block", "left_semi"))
        if known is not None:
            rows = rows.union(known.join(active, "block", "left_semi").select("block", F.lit("known").alias("kind"), F.col("stage").alias("a"), none))
        return cut(rows.groupBy("block").applyInArrow(_walk, f"block int, stage {kind}"))

    fresh = walked(placed.filter("seed").select("block", "stage"), None)
    reached, held = fresh, [fresh]
    while True:
        found = fresh.select(F.col("stage").alias("needs"))
        onward = cut(across.join(found, "needs").select("block", "stage").distinct().join(reached.select("stage"), "stage", "left_anti"))
        if onward.isEmpty():
            discard(placed, lines, onward)
            break
        fresh = walked(onward.select("block", "stage"), reached)
        held.append(fresh)
        reached = reached.union(fresh)
        discard(onward)
    out = cut(reached.select("stage"))
    discard(*held)
    return out


def _closure(edges: DataFrame) -> DataFrame:
    """stage, ancestor, by doubling: each round writes all pairs found so far."""
    reach = cut(edges.select("stage", F.col("needs").alias("ancestor")).distinct())
    size = reach.count()
    while True:
        onward = reach.select(F.col("stage").alias("ancestor"), F.col("ancestor").alias("next"))
        further = cut(reach.union(reach.join(onward, "ancestor").select("stage", "next")).distinct())
        discard(reach)
        reach, grown = further, further.count()
        if grown == size:
            return reach
        size = grown


def _reach(own: bool, to_doors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (stage, ancestor) of what stages reach inside a region: its doors, or all but its doors. Rows: region, part,
    kind, a, b, sorted by the first four. Kinds: 0, an edge; 1, a door; 2, a stage from which b is reached already. own:
    walks from all stages of the region, else from those of kind 2. A task holds the edges of one region and one walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, below, doors, origin, starts, out, kind = None, {}, set(), None, [], ([], []), None

        def walk(stage, todo: list) -> None:
            known, todo = set(), [x for s in todo for x in below.get(s, ())]
            while todo:
                x = todo.pop()
                if x not in known:
                    known.add(x)
                    todo += below.get(x, ())
            found = known & doors if to_doors else known - doors if doors else known
            out[0].extend([stage] * len(found))
            out[1].extend(found)

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c in out], ["stage", "ancestor"])
            out[0].clear(), out[1].clear()
            return batch

        def ended() -> Iterator[pa.RecordBatch]:
            """What is left to walk when a region's rows are over."""
            if starts:
                walk(origin, starts)
            for stage in below if own else ():
                walk(stage, [stage])
                if len(out[0]) >= SENT:
                    yield sent()

        for batch in batches:
            kind = batch.schema.field("a").type
            for region, part, what, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (region, part):
                    yield from ended()
                    held, below, doors, starts = (region, part), {}, set(), []
                if what == 0:
                    below.setdefault(a, []).append(b)
                elif what == 1:
                    doors.add(a)
                else:
                    if starts and a != origin:
                        walk(origin, starts)
                        starts = []
                    origin = a
                    starts.append(b)
                if len(out[0]) >= SENT:
                    yield sent()
        yield from ended()
        if out[0]:
            yield sent()

    return run


def ancestors(edges: DataFrame, near: Sequence[str] = (), part: int = PART) -> DataFrame:
    """stage, ancestor: every stage that a stage depends on, directly or not. Cycles end where they began.

    near: columns of edges whose values are one for all edges of a stage, and that keep stages that lie near each other
    together, some BLOCK of them at most, as a project and a stretch of its places do. Stages with the same values are a
    region, which a task walks from each of its stages; the pairs are neither shuffled nor written. Stages found in several
    regions are the regions' doors. Only pairs with a door as ancestor meet in joins, and a region that many outside reach
    is walked in parts, each from about `part` stages. So exactness doesn't rest on `near`, only the bytes moved do; without
    it all pairs are joined and written in rounds."""
    if not near:
        return _closure(edges)
    lines = edges.select(F.xxhash64(*near).alias("region"), "stage", "needs")
    ends = lines.select("region", F.explode(F.array("stage", "needs")).alias("stage"))
    doors = cut(ends.groupBy("stage").agg(F.min("region").alias("first"), F.max("region").alias("last")).filter("first <> last").select("stage"))

    def walked(parts: DataFrame | None, own: bool, to_doors: bool, *more: tuple[int, DataFrame]) -> DataFrame:
        """more: kinds of rows with region, a and b."""
        lone = F.lit(0).alias("part")
        rows = None
        for what, these in ((0, lines.toDF("region", "a", "b")), *more):
            these = these.withColumn("kind", F.lit(what))
            if parts is not None:
                deal = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int") if what == 2 else F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
                these = these.join(parts, "region").withColumn("part", deal)
            else:
                these = these.withColumn("part", lone)
            these = these.select("region", "part", "kind", "a", "b")
            rows = these if rows is None else rows.union(these)
        dealt = rows.repartition("region", "part").sortWithinPartitions("region", "part", "kind", "a")
        name = edges.schema["stage"].dataType.simpleString()
        return dealt.mapInArrow(_reach(own, to_doors), f"stage {name}, ancestor {name}")

    if doors.isEmpty():
        discard(doors)
        return walked(None, True, False)
    at = cut(ends.join(doors, "stage").distinct().select("region", F.col("stage").alias("a"), F.col("stage").alias("b")))
    hops = cut(walked(None, True, True, (1, at)))
    between = _closure(hops.join(doors, "stage", "left_semi").withColumnRenamed("ancestor", "needs"))
    onward = between.select(F.col("stage").alias("ancestor"), F.col("ancestor").alias("next"))
    far = cut(hops.union(hops.join(onward, "ancestor").select("stage", "next")).distinct())
    discard(hops, between)
    home = lines.select("region", "stage").distinct()
    entered = far.join(home.withColumnRenamed("stage", "ancestor"), "ancestor").select("region", F.col("stage").alias("a"), F.col("ancestor").alias("b"))
    begun = cut(home.select("region", F.col("stage").alias("a"), F.col("stage").alias("b")).union(entered))
    parts = cut(begun.groupBy("region").agg(F.ceil(F.count("*") / part).alias("parts")))
    discard(doors)
    return far.union(walked(parts, False, False, (1, at), (2, begun)))


def out_of_order(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose dependency is unknown or doesn't stand before the stage."""
    own, need = stages.select("stage", "place"), stages.select(F.col("stage").alias("needs"), F.col("place").alias("need_place"))
    j = edges.join(own, "stage").join(need, "needs", "left")
    return j.filter(F.col("need_place").isNull() | (F.col("need_place") >= F.col("place"))).select("stage", "needs")


def blockers(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """stage, needs, status of dependencies that are not accepted."""
    return edges.join(stages.select(F.col("stage").alias("needs"), "status"), "needs").filter("status <> 'accepted'").select("stage", "needs", "status")


def runnable(stages: DataFrame, edges: DataFrame, paid: bool = False) -> DataFrame:
    """Pending stages with attempts left, leave to run, and all dependencies accepted."""
    blocked = blockers(stages, edges).select("stage").distinct()
    may = (F.col("status") == "pending") & (F.col("attempts") < F.col("max_attempts")) & (F.lit(paid) | ~F.col("paid"))
    return stages.filter(may).join(blocked, "stage", "left_anti").select("stage")


def signatures(stages: DataFrame, edges: DataFrame, engine: str = "1") -> DataFrame:
    """stage, signature: the identity of all that a stage's result rests on, namely its own specification, the digests of
    its inputs, the digests of the results of its direct needs, its adapter's and the engine's; null while one of its needs
    isn't accepted. What lies further up shows in the results of the direct needs. stages: stage, status, spec (JSON),
    inputs (map of names to digests), fingerprint (of the adapter), result (digest)."""
    need = stages.select(F.col("stage").alias("needs"), "result", (F.col("status") == "accepted").alias("open"))
    above = edges.distinct().join(need, "needs", "left").groupBy("stage").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("needs").cast("string"), "result"))).alias("dependencies"), F.bool_and(F.coalesce("open", F.lit(False))).alias("open")
    )
    both = stages.select("stage", "spec", "inputs", "fingerprint").join(above, "stage", "left")
    digests = MapType(StringType(), StringType())
    parts = {"adapter": F.col("fingerprint"), "dependencies": F.coalesce("dependencies", F.create_map().cast("map<string,string>")), "engine": F.lit(engine), "inputs": F.col("inputs"), "stage": F.col("spec")}
    form = StructType([StructField(k, digests if k in ("dependencies", "inputs") else StringType()) for k in parts])
    signature = identity(F.struct(*(c.alias(k) for k, c in parts.items())), form)
    return both.select("stage", F.when(F.coalesce("open", F.lit(True)), signature).alias("signature"))


def stale(stages: DataFrame, edges: DataFrame, engine: str = "1") -> DataFrame:
    """Accepted or reviewed stages whose recorded signature isn't the present one, whose result isn't found as recorded, or
    that need a stale stage. stages: as for signatures, with project, place, signature (recorded) and found (the digest of
    the result as it lies there now)."""
    live = F.col("status").isin("accepted", "awaiting_review")
    now = signatures(stages, edges, engine).withColumnRenamed("signature", "now")
    same = F.coalesce((F.col("signature") == F.col("now")) & (F.col("found") == F.col("result")), F.lit(False))
    return downstream(stages.join(now, "stage").select("stage", "project", "place", (~same).alias("seed"), live.alias("carries")), edges)


def revised(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """stage, status after a revision: stages whose specification or inputs changed, freezes of a project in which any
    specification changed, and all that need such a stage are pending again. old: stage, project, place, role, status, spec,
    inputs; new: stage, spec, inputs."""
    digest = F.to_json(F.array_sort(F.map_entries("inputs")))
    was = old.select("*", digest.alias("was_inputs")).drop("inputs").withColumnRenamed("spec", "was_spec")
    both = was.join(new.select("stage", "spec", digest.alias("inputs")), "stage", "left")
    other = ~F.col("spec").eqNullSafe(F.col("was_spec"))
    both = cut(both.select("stage", "project", "place", "role", "status", other.alias("other"), (other | ~F.col("inputs").eqNullSafe(F.col("was_inputs"))).alias("changed")))
    moved = both.groupBy("project").agg(F.bool_or("other").alias("moved"))
    seed = F.col("changed") | (F.col("moved") & F.coalesce(F.col("role") == "freeze", F.lit(False)))
    below = downstream(both.join(moved, "project").select("stage", "project", "place", seed.alias("seed"), F.lit(True).alias("carries")), edges).withColumn("again", F.lit(True))
    return both.join(below, "stage", "left").select("stage", F.when(F.col("again"), "pending").otherwise(F.col("status")).alias("status"))


def unfrozen_holdouts(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Holdout stages without a reviewed freeze among their direct needs."""
    frozen = edges.join(stages.filter("role = 'freeze' AND review").select(F.col("stage").alias("needs")), "needs").select("stage")
    return stages.filter("split = 'holdout'").join(frozen, "stage", "left_anti").select("stage")


def leaks(stages: DataFrame, edges: DataFrame, roles=("proposal", "literature")) -> DataFrame:
    """Stages in roles that must not see holdout results, but rest on one, directly or not."""
    held = stages.select("stage", "project", "place", (F.col("split") == "holdout").alias("seed"), F.lit(True).alias("carries"))
    below = edges.join(downstream(held, edges).withColumnRenamed("stage", "needs"), "needs", "left_semi").select("stage").distinct()
    return stages.filter(F.col("role").isin(*roles)).select("stage").join(below, "stage", "left_semi")


def unreviewed(stages: DataFrame, roles=("proposal", "freeze", "interpretation")) -> DataFrame:
    """Scientific decisions that no supervisor reviews."""
    return stages.filter(F.col("role").isin(*roles) & ~F.col("review")).select("stage")


def project_status(stages: DataFrame, keys=()) -> DataFrame:
    """keys, status of each project."""
    every, some = F.bool_and(F.col("status") == "accepted"), lambda *s: F.bool_or(F.col("status").isin(*s))
    status = F.when(some("terminated"), "terminated").when(every, "completed").when(some("awaiting_review", "stale", "failed", "running"), "awaiting").otherwise("ready")
    return stages.groupBy(*keys).agg(status.alias("status"))


#: What becomes of a stage after a decision.
DECISIONS = {"accept": "accepted", "reject": "rejected", "request_changes": "changes_requested", "terminate": "rejected"}
#: Statuses from which a stage may be tried again.
RETRIED = ("failed", "running", "changes_requested", "rejected", "stale")


def binding(*parts) -> Column:
    """What a review is bound to: signature, result, attempt and protocol of the stage as it was read."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def decided(stages: DataFrame, decisions: DataFrame) -> DataFrame:
    """stage, action, outcome: the new status, or why the decision doesn't count. stages: stage, status, binding;
    decisions: stage, action, actor, reason, binding (as read by the reviewer)."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    status = F.element_at(F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv)), F.col("action"))
    both = decisions.withColumnRenamed("binding", "read").join(stages, "stage", "left")
    outcome = (
        F.when(~F.coalesce(F.col("action").isin(*DECISIONS), F.lit(False)) | empty("actor") | empty("reason"), "incomplete")
        .when(F.col("status").isNull() | (F.col("status") != "awaiting_review"), "not under review")
        .when(~F.col("read").eqNullSafe(F.col("binding")), "out of date")
        .otherwise(status)
    )
    return both.select("stage", "action", outcome.alias("outcome"))


def retries(stages: DataFrame) -> DataFrame:
    """stage, verdict: whether a stage may be tried again. A holdout that was tried never is."""
    verdict = (
        F.when(~F.col("status").isin(*RETRIED), "status")
        .when((F.col("split") == "holdout") & (F.col("attempts") > 0), "holdout")
        .when(F.col("attempts") >= F.col("max_attempts"), "attempts")
        .otherwise("pending")
    )
    return stages.select("stage", verdict.alias("verdict"))


def resumable(recorded: DataFrame, now: DataFrame, parts=("plan", "script", "engine")) -> DataFrame:
    """run, resumes, changed: a recorded run resumes only if each part of its fingerprint is as it was."""
    was = recorded.select("run", *(F.col(p).alias(f"was_{p}") for p in parts))
    differs = F.array_compact(F.array(*(F.when(~F.col(p).eqNullSafe(F.col(f"was_{p}")), F.lit(p)) for p in parts)))
    return was.join(now.select("run", *parts), "run", "left").select("run", (F.size(differs) == 0).alias("resumes"), F.array_join(differs, ",").alias("changed"))


def reused(jobs: DataFrame, broken: DataFrame) -> DataFrame:
    """job, action: completed jobs are reused if none of their files is broken, else invalidated; others run. jobs: job,
    status; broken: job, one row for each file that isn't what its manifest says."""
    bad = broken.select("job").distinct().withColumn("bad", F.lit(True))
    action = F.when(F.col("status") != "completed", "run").when(F.col("bad"), "invalidated").otherwise("reused")
    return jobs.join(bad, "job", "left").select("job", action.alias("action"))

"""Queries over grids, ledgers, feeds, stage graphs, manifests and tables; and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.canonical import canonical
from ..operators import evaluation as E
from ..operators import lineage as L
from ..operators import memory as M
from ..operators import records as R
from ..operators.excerpts import locate
from ..sources import tables as S
from . import memory as PM
from .retrieval import weights_sql

#: The invented texts' own forms of secrets, beside those of functions.text.
SECRETS = (r"AKIA[0-9A-Z]{16}", r"token = \"[0-9a-f]{40}\"")
METHODS = ("recent_window", "events_only", "keyed_memory", "fifo_memory", "first_write")
BASELINE = "recent_window"
#: Seeds of the grids; each stands for the tasks with its remainder.
SEEDS = 24


# ------------------------------------------------ grids
def _results(spark, d):
    """method, seed, metric, dataset_sha256: accuracy of each memory on the tasks of each of 24 seeds."""
    e, out = S.keyed_events(spark, d), None
    kept = (M.recent(e), M.recent(e, keyed_only=True), M.keyed(e), M.bounded_map(e), M.bounded_map(e, keep_first=True))
    for name, k in zip(METHODS, kept, strict=True):
        a = PM._answers(k, e).groupBy((F.col("task") % SEEDS).alias("seed")).agg(F.avg(F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).cast("int")).alias("metric")).withColumn("method", F.lit(name))
        out = a if out is None else out.unionByName(a)
    digest = e.groupBy((F.col("task") % SEEDS).alias("seed")).agg(F.sha2(F.concat_ws(":", F.max(F.col("task") % SEEDS).cast("string"), F.count("*").cast("string")), 256).alias("dataset_sha256"))
    return out.join(digest, "seed")


def grid_results(spark, d):
    return _results(spark, d).select("method", "seed", F.round("metric", 9).alias("metric"), "dataset_sha256")


def grid_complete(spark, d):
    methods = spark.createDataFrame([(m,) for m in METHODS], "method string")
    seeds = S.keyed_events(spark, d).select((F.col("task") % SEEDS).alias("seed")).distinct()
    have = _results(spark, d).filter("NOT (method = 'events_only' AND seed % 7 = 3)")
    return R.completeness(R.job_grid(methods, seeds), have)


def grid_summary(spark, d):
    s = R.summary(R.valid_results(_results(spark, d)), BASELINE)
    return s.select("method", "n", *(F.round(c, 9).alias(c) for c in ("mean", "sd", "delta_mean", "delta_sd")))


def grid_outcomes(spark, d):
    s = R.summary(_results(spark, d), BASELINE)
    return s.select("method", T.outcome(F.round("delta_mean", 9)).alias("outcome"), F.format_string("%.6f", F.round("mean", 9)).alias("mean"), F.format_string("%+.6f", F.round("delta_mean", 9)).alias("delta"))


def same_data_check(spark, d):
    r = _results(spark, d)
    broken = F.when((F.col("seed") == 5) & (F.col("method") == "fifo_memory"), F.lit("0" * 64)).when((F.col("seed") == 6) & (F.col("method") == "keyed_memory"), F.lit(None)).otherwise(F.col("dataset_sha256"))
    return R.same_data(r.withColumn("dataset_sha256", F.when(F.col("seed") != 7, broken)))


def _means(spark, d):
    return _results(spark, d).filter("seed < 12").groupBy("method").agg(F.round(F.avg("metric"), 9).alias("score"))


def search_fold(spark, d):
    means = _means(spark, d)
    place = F.element_at(F.create_map(*(x for i, m in enumerate(("events_only", "fifo_memory", "first_write", "keyed_memory")) for x in (F.lit(m), F.lit(i)))), F.col("method"))
    base = means.agg(F.max(F.when(F.col("method") == BASELINE, F.col("score"))).alias("b")).first()["b"]
    scores = means.filter(F.col("method") != BASELINE).select(place.alias("place"), F.col("method").alias("candidate"), "score")
    return R.search(scores, F.lit(base), 0.01, 4, 2)


def holdout_methods(spark, d):
    kept = search_fold(spark, d).filter("accepted").agg(F.max_by("candidate", "place").alias("incumbent"))
    chosen = F.array_distinct(F.array(F.lit(BASELINE), F.coalesce("incumbent", F.lit(BASELINE)), F.lit("fifo_memory"), F.lit("events_only")))
    return kept.select(F.posexplode(chosen).alias("place", "method"))


def holdout_claims(spark, d):
    """Paired differences on the other seeds with order-statistic intervals."""
    r = _results(spark, d).filter("seed >= 12")
    base = r.filter(F.col("method") == BASELINE).select("seed", F.col("metric").alias("base"))
    diff = r.filter(F.col("method") != BASELINE).join(base, "seed").select("method", F.col("seed").alias("uid"), (F.col("metric") - F.col("base")).alias("delta"))
    found = E.weighted_order(diff, ["method"], "delta")
    return found.select("method", "n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


def audit_diff(spark, d):
    """Recorded against recomputed decisions: rows of either side that the other lacks."""
    now = search_fold(spark, d).select("place", "candidate", "accepted")
    recorded = now.withColumn("accepted", F.when(F.col("place") == 0, ~F.col("accepted")).otherwise(F.col("accepted")))
    return now.exceptAll(recorded).withColumn("side", F.lit("recomputed")).union(recorded.exceptAll(now).withColumn("side", F.lit("recorded")))


# ------------------------------------------------ ledgers
def _requests(spark, d):
    return requests_of(S.table(spark, d, "events"))


def requests_of(e):
    k = F.get_json_object("props", "$.k").cast("long")
    even = F.col("event_id") % 2 == 0
    raw = F.struct(
        F.when(even & (k % 13 != 0), k * 2).alias("input_tokens"), F.when(~even & (k % 13 != 0), k * 2).alias("prompt_tokens"),
        F.when(even, F.floor("value")).cast("long").alias("output_tokens"), F.when(~even, F.floor("value")).cast("long").alias("completion_tokens"),
        F.when(k % 3 == 0, k).alias("total_tokens"), k.alias("cached_input_tokens"), F.lit(4).cast("long").alias("reasoning_output_tokens"),
    )
    status = F.when(F.col("event_type") == "error", "unknown").when(k % 10 == 0, "active").otherwise("settled")
    return e.select(F.col("event_id").alias("pos"), F.col("event_type").alias("alias"), F.col("user_id").alias("task"), k.alias("k"), (k + 100).alias("reserved_tokens"), status.alias("status"), T.usage(raw).alias("u"), "ts")


def usage_normalized(spark, d):
    return _requests(spark, d).select("pos", "u.*")


def ledger_rollup(spark, d):
    r = _requests(spark, d).select("*", "u.*").na.fill(0, ["input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_output_tokens"])
    models = spark.createDataFrame([("click", 200000), ("view", 100000), ("purchase", 1000000), ("error", 90000), ("spare", 500)], "alias string, limit long")
    return R.rollup(r, models)


def admission_fold(spark, d):
    r = _requests(spark, d).select("task", "pos", (F.col("k") % 7 + 1).cast("double").alias("seconds"))
    return R.admission(r, 20, 60.0)


def request_cache(spark, d):
    return R.cached_requests(_requests(spark, d).select("pos", "alias", "k", "status"), ["alias", "k"]).groupBy("alias").agg(F.count("*").alias("n"), F.count_if("reused").alias("reused"))


def ledger_latest(spark, d):
    """The newest state of each request id, from an append-only log."""
    r = _requests(spark, d)
    log = r.select((F.col("pos") % 1000).alias("id"), "pos", "status", "reserved_tokens")
    return log.groupBy("id").agg(F.max_by("status", "pos").alias("status"), F.max_by("reserved_tokens", "pos").alias("reserved_tokens"), F.count("*").alias("states"))


def settle_reservations(spark, d):
    """Reservations shrink to actual usage when settled, and stay whole otherwise; an over-run is marked."""
    r = _requests(spark, d)
    actual = F.when(F.col("status") == "settled", F.col("u.total_tokens"))
    return r.groupBy("task").agg(F.sum(F.coalesce(actual, F.col("reserved_tokens"))).alias("charged"), F.count_if(actual > F.col("reserved_tokens")).alias("overruns"))


def recent_requests(spark, d):
    return R.tail_per_key(_requests(spark, d), "alias", "pos").select("alias", "pos", "rn", "status", "reserved_tokens")


# ------------------------------------------------ feeds
#: Events that a request's state stands for.
REQUEST_EVENTS = {"settled": "model_completed", "unknown": "model_usage_unknown"}


def feed_of(read):
    """Run events, task events, model requests and project events in one feed. read: gives a table by its name, at rest or
    as a stream."""
    e = read("events").select(F.col("ts").cast("string").alias("time"), F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.concat(F.lit("run-"), (F.col("user_id") % 24).cast("string")).alias("owner"))
    o = read("orders").select(F.col("o_orderdate").cast("string").alias("time"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending").alias("event"))
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in REQUEST_EVENTS.items() for x in kv)), F.col("status")), F.lit("model_started"))
    r = requests_of(read("events")).select(F.col("ts").cast("string").alias("time"), F.col("pos").alias("id"), named.alias("event"), F.col("alias").alias("owner"))
    p = read("lineitem").select(F.col("l_shipdate").cast("string").alias("time"), F.col("l_orderkey").alias("id"), F.lit("stage_shipped").alias("event"), F.concat(F.lit("project-"), F.col("l_suppkey").cast("string")).alias("owner"))
    return e.unionByName(o, allowMissingColumns=True).unionByName(r).unionByName(p)


def _feed(spark, d):
    return feed_of(lambda name: S.table(spark, d, name))


def feed_top80(spark, d):
    return R.newest(_feed(spark, d)).select("id", "event", "owner")


def _runs(spark, d):
    e = S.table(spark, d, "events")
    last = e.groupBy((F.col("user_id") % 24).alias("run")).agg(F.max_by("event_type", "event_id").alias("last"), F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "purchase").alias("jobs"), F.max("event_id").alias("modified"))
    return last.withColumn("status", F.when(F.col("last") == "purchase", "completed").when(F.col("last") == "error", "failed").when(F.col("last") == "click", "running").otherwise("pending"))


def board_totals(spark, d):
    active = F.col("status").isin("running", "searching", "evaluating_holdout", "writing", "requesting")
    return _runs(spark, d).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum("jobs").alias("jobs"), F.sum("attempts").alias("attempts"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "pending").alias("pending"))


def grid_progress(spark, d):
    e = S.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy((F.col("user_id") % 24).alias("run")).agg((F.count_distinct("event_type") * F.count_distinct(F.col("k") % 5)).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.sum(F.col("k") % 3 + 1).alias("attempts"))


def runs_by_time(spark, d):
    from pyspark.sql import Window

    return _runs(spark, d).select("run", "status", F.row_number().over(Window.orderBy(F.desc("modified"))).alias("place"))


def alerts_union(spark, d):
    """alert, of, n: what seven producers have to say."""
    r, docs, stages = _requests(spark, d), S.table(spark, d, "documents"), _graph(spark, d)[0]
    said = lambda rows, alert, of: rows.groupBy(of.alias("of")).agg(F.count("*").alias("n")).select(F.lit(alert).alias("alert"), "of", "n")
    last = r.groupBy("alias").agg(F.max_by("status", "pos").alias("status"))
    projects = S.table(spark, d, "customer").select(F.col("c_custkey").alias("project")).join(stages.select("project").distinct(), "project", "left_anti")
    return reduce(
        DataFrame.unionByName,
        (
            said(r.filter("status = 'unknown'"), "unsettled usage", F.col("alias")),
            said(r.filter("u IS NULL"), "unreadable usage", F.col("alias")),
            said(last.filter("status = 'unknown'"), "last request failed", F.col("alias")),
            said(_runs(spark, d).filter("status = 'failed'"), "failed run", F.concat(F.lit("run-"), F.col("run").cast("string"))),
            said(docs.filter(F.length("text") != F.col("n_chars")), "wrong length", F.col("source")),
            said(stages.filter("status IN ('awaiting_review', 'failed', 'stale')"), "stage", F.concat_ws("/", F.col("project").cast("string"), "status")),
            said(projects, "project without record", F.col("project").cast("string")),
        ),
    )


def run_errors(spark, d):
    """The first five errors of each run."""
    e = S.table(spark, d, "events").filter("event_type = 'error'").select((F.col("user_id") % 24).alias("run"), "event_id")
    return R.first_per_key(e, "run", "event_id", 5).select("run", F.array_join(F.col("first").cast("array<string>"), ",").alias("first"))


def first_runs(spark, d):
    """The three runs changed last, of those that failed or run; path searched without regard to case."""
    r = _runs(spark, d).withColumn("path", F.concat(F.lit("Runs/RUN-"), F.col("run").cast("string")))
    shown = r.filter(F.col("status").isin("failed", "running", "pending") & F.contains(F.lower("path"), F.lit("run-1")))
    return shown.orderBy(F.desc("modified")).limit(3).select("run", "status")


def grids_in_order(spark, d):
    """Grids by name, the holdout last."""
    from pyspark.sql import Window

    name = F.when(F.col("n_nationkey") == 7, "holdout").otherwise(F.lower("n_name"))
    n = S.table(spark, d, "nation").select(name.alias("name"))
    return n.select("name", F.row_number().over(Window.orderBy(F.col("name") == "holdout", "name")).alias("place"))


def ledger_faults(spark, d):
    """Entries that come after their request was finished, in a log where ten requests share an id."""
    r = _requests(spark, d).select(F.expr("pos DIV 10").alias("id"), "pos", "status")
    return R.ledger_faults(r)


def planned_anti(spark, d):
    planned = S.table(spark, d, "documents").select(F.col("doc_id").alias("task_id"))
    return planned.join(S.table(spark, d, "labels").select(F.col("doc_id").alias("task_id")), "task_id", "left_anti")


def ui_filter(spark, d):
    """Substring search over a whole row as JSON, whatever the case."""
    p = S.table(spark, d, "pages")
    return p.filter(F.contains(F.lower(F.to_json(F.struct(*p.columns))), F.lit("blog."))).select("page_id")


# ------------------------------------------------ stage graphs
def _graph(spark, d):
    """Each customer's orders as the stages of a project: a stage needs the two orders before it by key, so there are as
    many diamonds as stages; places go by date, so some dependencies stand too late."""
    o = S.table(spark, d, "orders")
    kind = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % n + 1).cast("int"))
    stages = o.select(
        F.col("o_orderkey").alias("stage"), F.col("o_custkey").alias("project"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("place"),
        kind(5, "artifact", "literature_cards", "tabular_experiment", "proposal", "freeze").alias("adapter"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "proposal").when(F.col("o_orderpriority") == "2-HIGH", "freeze").when(F.col("o_orderpriority") == "3-MEDIUM", "literature")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "interpretation").alias("role"), (F.col("o_totalprice") >= 60_000).alias("review"),
        F.when(F.col("o_orderkey") % 11 == 0, "holdout").otherwise("development").alias("split"),
        F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise(kind(3, "awaiting_review", "failed", "stale")).alias("status"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("o_orderpriority").startswith("1").alias("paid"),
    )
    return stages, _edges(o).select("stage", "needs")


def _edges(o, stretch: int = L.BLOCK):
    """stage, needs, and what keeps stages together: their project, and stretches of so many of its stages."""
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    both = F.array(F.lag("o_orderkey", 1).over(by), F.lag("o_orderkey", 2).over(by)).alias("both")
    edges = o.select(F.col("o_orderkey").alias("stage"), F.col("o_custkey").alias("project"), F.floor((F.row_number().over(by) - 1) / stretch).alias("stretch"), both)
    return edges.select("stage", "project", "stretch", F.explode("both").alias("needs")).filter("needs IS NOT NULL")


def dag_ancestors(spark, d):
    return L.ancestors(_edges(S.table(spark, d, "orders")), ("project", "stretch"))


def _dag(f):
    return lambda spark, d: f(*_graph(spark, d))


def _recorded(spark, d):
    """The stages with what they rest on, as recorded and now: spec and inputs (an order's line items, up to a day, and
    all), the adapter's fingerprint, the result (its price) and what is found of it (less large returns)."""
    o, lines = S.table(spark, d, "orders"), S.table(spark, d, "lineitem")
    line = F.concat_ws(":", *(F.col(c).cast("long").cast("string") for c in ("l_linenumber", "l_partkey", "l_quantity")))
    early = F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp")
    returned = F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), F.col("l_extendedprice").cast("decimal(18,2)")))
    held = lines.groupBy(F.col("l_orderkey").alias("stage")).agg(F.collect_list(F.when(early, line)).alias("was"), F.collect_list(line).alias("now"), returned.alias("returned"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    both = _graph(spark, d)[0].join(o.select(F.col("o_orderkey").alias("stage"), price.alias("price")), "stage").join(held, "stage", "left")
    digest = lambda c: F.create_map(F.lit("lines"), F.sha2(F.concat_ws(",", F.array_sort(F.coalesce(c, F.array()))), 256))
    count = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
    form = StructType().add("adapter", "string").add("config", StructType().add("lines", "integer")).add("id", "long")
    spec = lambda c: canonical(F.struct(F.col("adapter").alias("adapter"), F.struct(count(c).alias("lines")).alias("config"), F.col("stage").alias("id")), form)
    found = F.col("price") - F.coalesce("returned", F.lit(0).cast("decimal(18,2)"))
    return both.select(
        *_graph(spark, d)[0].columns, spec("was").alias("old_spec"), spec("now").alias("spec"), digest("was").alias("old_inputs"), digest("now").alias("inputs"),
        F.sha2("adapter", 256).alias("fingerprint"), F.sha2(F.col("price").cast("string"), 256).alias("result"), F.sha2(found.cast("decimal(18,2)").cast("string"), 256).alias("found"),
    )


def dag_signatures(spark, d):
    return L.signatures(_recorded(spark, d), _graph(spark, d)[1])


def dag_stale(spark, d):
    """Signatures were recorded over the inputs of an earlier day."""
    stages, edges = _recorded(spark, d), _graph(spark, d)[1]
    recorded = L.signatures(stages.drop("inputs").withColumnRenamed("old_inputs", "inputs"), edges)
    return L.stale(stages.join(recorded, "stage"), edges)


def dag_revision(spark, d):
    stages = _recorded(spark, d)
    old = stages.drop("spec", "inputs").withColumnsRenamed({"old_spec": "spec", "old_inputs": "inputs"})
    return L.revised(old, stages.select("stage", "spec", "inputs"), _graph(spark, d)[1])


def dag_unreviewed(spark, d):
    return L.unreviewed(_graph(spark, d)[0])


def dag_status(spark, d):
    return L.project_status(_graph(spark, d)[0], ("project",))


def dag_retries(spark, d):
    return L.retries(_graph(spark, d)[0])


def dag_decisions(spark, d):
    """A decision on each stage; some are incomplete or bound to an older result."""
    stages = _graph(spark, d)[0].withColumn("binding", L.binding(F.col("stage").cast("string"), F.col("attempts").cast("string"), F.lit("protocol")))
    actions = F.element_at(F.array(*map(F.lit, (*L.DECISIONS, "ignore"))), (F.col("stage") % 5 + 1).cast("int"))
    old = F.when(F.col("stage") % 6 == 0, F.lit("older")).otherwise(F.col("binding"))
    given = stages.select("stage", actions.alias("action"), F.lit("supervisor").alias("actor"), F.when(F.col("stage") % 17 == 0, " ").otherwise("read").alias("reason"), old.alias("binding"))
    return L.decided(stages.select("stage", "status", "binding"), given)


def run_resumes(spark, d):
    """Suppliers as runs, of which some have another plan, script or engine now."""
    s = S.table(spark, d, "supplier")
    part = lambda name, n: F.concat_ws(":", F.lit(name), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % n == 0, F.lit("new")))
    recorded = s.select(F.col("s_suppkey").alias("run"), *(F.concat_ws(":", F.lit(n), F.col("s_suppkey").cast("string")).alias(n) for n in ("plan", "script", "engine")))
    now = s.filter("s_suppkey > 0").select(F.col("s_suppkey").alias("run"), part("plan", 3).alias("plan"), part("script", 4).alias("script"), part("engine", 5).alias("engine"))
    return L.resumable(recorded, now)


def job_reuse(spark, d):
    """Orders as jobs and their lines as files; a returned line is a broken file."""
    jobs = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    return L.reused(jobs, S.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job")))


# ------------------------------------------------ manifests and text
def _documents(spark, d):
    return S.table(spark, d, "documents")


def manifest_build(spark, d):
    return R.manifest(_documents(spark, d), "doc_id", "text")


def manifest_diff(spark, d):
    docs = _documents(spark, d)
    recorded = R.manifest(docs, "doc_id", "text").withColumn("sha256", F.when(F.col("path").cast("long") % 89 == 1, "bad").otherwise(F.col("sha256")))
    now = docs.filter("doc_id % 101 <> 5").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.manifest_diff(recorded, R.manifest(now, "doc_id", "text")).filter("state <> 'ok'")


def evidence_gate(spark, d):
    """Every document as a claim, on itself and the ids one and seven further on; evidence is every document."""
    docs = _documents(spark, d)
    claims = docs.select(F.col("doc_id").alias("claim"), F.array(*((F.col("doc_id") + k).cast("string") for k in (0, 1, 7))).alias("refs"))
    return R.claim_gate(claims, R.manifest(docs, "doc_id", "text"))


def dedupe_blobs(spark, d):
    docs = _documents(spark, d)
    return R.unique_blobs(docs.select(F.format_string("%012d", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256")))


def redact(spark, d):
    patterns = (*T.REDACTED, *SECRETS)
    return _documents(spark, d).filter(F.col("text").rlike("|".join(patterns))).select("doc_id", F.sha2(T.redact(F.col("text"), patterns), 256).alias("redacted_sha256"))


#: What patterns find, and the size from which a text is too large to share.
FINDINGS = tuple(zip(("secret key", "GitHub token", "GitHub fine-grained token", "private key", "access key", "token"), (*T.CREDENTIALS, *SECRETS), strict=True))
LARGE = 5_000_000


def secret_scan(spark, d):
    hits = [F.when(F.col("text").rlike(p), F.lit(n)) for n, p in FINDINGS]
    big = F.when(F.octet_length("text") > LARGE, F.lit("too large"))
    return _documents(spark, d).select("doc_id", F.explode(F.filter(F.array(*hits, big), lambda x: x.isNotNull())).alias("finding"))


def share_scan(spark, d):
    """Documents as files of folders that go by language, with suffixes that go by length."""
    folder = F.when(F.col("lang") == "de", "data").when(F.col("lang") == "fr", "config/projects/notes").when(F.col("lang") == "es", "config/projects/notes/outputs").otherwise("docs")
    name = F.when(F.col("n_chars") > 9000, F.concat("source", F.lit(".ZIP"))).when(F.col("n_chars") < 300, F.concat(F.lit(".env"), F.when(F.col("n_chars") < 150, ".example").otherwise(""))).otherwise(F.concat("source", F.lit(".txt")))
    docs = S.table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.explode(T.share_issues(F.concat_ws("/", folder, name), F.col("text"))).alias("finding"))


def locate_excerpt(spark, d):
    """doc_id, item_id, place: every benchmark text that stands in a document, at its first place."""
    items = S.table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("excerpt"))
    found = locate(_documents(spark, d).select(F.col("doc_id").cast("long").alias("id"), "text"), items)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "place")


def json_pointer(spark, d):
    e = S.table(spark, d, "events")
    return e.select("event_id", F.get_json_object(F.concat(F.lit('{"a/b": [1, '), F.col("props"), F.lit("]}")), T.pointer_path("/a~1b/1/k")).cast("long").alias("k"))


def evidence_calc(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    same = F.col("event_type") == "view"
    value = F.when(same, k).otherwise(F.col("value") - k)
    return S.table(spark, d, "events").select("event_id", F.when(same, "identity").otherwise("difference").alias("op"), F.round(value, 9).alias("result"))


def tex_escape(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.tex_escape(F.col("url")).alias("url"))


def path_rules(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    shaped = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), path)).when(F.col("page_id") % 7 == 0, F.concat(F.lit("/"), path)).otherwise(path)
    return S.table(spark, d, "pages").select("page_id", R.safe_path(shaped).alias("safe"))


def stratified_sample(spark, d):
    return R.stratified(_documents(spark, d), "lang", "doc_id", 20, "20260930").select("lang", "doc_id", "rn")


def hash_shuffle(spark, d):
    return R.numbered_within(_documents(spark, d).select("source", "doc_id"), "source", R.hash_order("v5-order", "doc_id")).select("source", "doc_id", F.col("place").cast("int").alias("place"))


# ------------------------------------------------ tables
def _tabular(spark, d):
    j = S.table(spark, d, "labels").join(_documents(spark, d).select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("x"), F.col("quality").cast("double").alias("y"))


def tabular_threshold(spark, d):
    return R.threshold_accuracy(_tabular(spark, d), (0.5, 1.0, 2.0)).withColumn("score", F.round("score", 9))


def tabular_linear(spark, d):
    return R.squared_error(_tabular(spark, d), (0.1, 0.25, 0.5)).withColumn("score", F.round("score", 6))


def comparison(spark, d):
    """Two thresholds compared where data, metric, direction, split and size all agree."""
    t = _tabular(spark, d)
    scores = []
    for p in (0.5, 2.0):
        by = t.withColumn("split", F.when(F.col("id") % 4 == 0, "holdout").otherwise("development"))
        by = by.filter("split = 'development' OR id % 5 > 0") if p > 1 else by
        score = F.avg(((F.col("x") >= p) == (F.col("y") != 0)).cast("int"))
        scores.append(by.groupBy("split").agg(score.alias("score"), F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.lit("labels"), F.count("*").cast("string")), 256).alias("dataset_sha256")).withColumns({"metric": F.lit("accuracy"), "direction": F.lit("maximize")}))
    keys = ["dataset_sha256", "metric", "direction", "split", "n"]
    return R.compare(*scores, keys, 0.0).select(*keys, F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), F.round("gain", 9).alias("gain"), "improved")


def split_overlap(spark, d):
    t = _tabular(spark, d)
    return t.filter("id % 3 = 0").select("id").intersect(t.filter("id % 5 = 0").select("id"))


def unique_ids(spark, d):
    t = _tabular(spark, d).select((F.col("id") % 97).alias("id"))
    return t.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def proposal_dupes(spark, d):
    """Proposals with a fingerprint that an earlier one had."""
    from pyspark.sql import Window

    p = S.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("fingerprint"))
    return p.withColumn("nth", F.row_number().over(Window.partitionBy("fingerprint").orderBy("pos"))).filter("nth > 1")


# ------------------------------------------------ SQL
_GRID_NAMES = dict(zip(METHODS, ("recent", "events_only", "keyed", "fifo", "first_write"), strict=True))
_GRID = f"""WITH RECURSIVE {PM._KEYED}, {', '.join(PM._kept(k) for k in _GRID_NAMES.values())},
sims AS ({' UNION ALL '.join(f"SELECT '{m}' AS method, t.task, t.expected, k.predicted FROM truth t LEFT JOIN kept_{k} k USING (task, key)" for m, k in _GRID_NAMES.items())}),
digests AS (SELECT task % {SEEDS} AS seed, sha256(any_value(task % {SEEDS}) || ':' || count(*)) AS dataset_sha256 FROM events2 GROUP BY 1),
results AS (SELECT method, seed, metric, dataset_sha256 FROM (SELECT method, task % {SEEDS} AS seed, avg(CAST(coalesce(predicted = expected, FALSE) AS INT)) AS metric FROM sims GROUP BY ALL) JOIN digests USING (seed))"""
_SUMMARY = f"""{_GRID}, based AS (SELECT *, metric - max(metric) FILTER (method = '{BASELINE}') OVER (PARTITION BY seed) AS delta FROM results),
summary AS (SELECT method, count(*) AS n, avg(metric) AS mean, stddev_samp(metric) AS sd, avg(delta) AS delta_mean, stddev_samp(delta) AS delta_sd FROM based GROUP BY method)"""
_SEARCH = f"""{_GRID}, means AS (SELECT method, round(avg(metric), 9) AS score FROM results WHERE seed < 12 GROUP BY method),
cands AS (SELECT CAST(list_position(['events_only', 'fifo_memory', 'first_write', 'keyed_memory'], method) - 1 AS INT) AS place, method AS candidate, score FROM means WHERE method <> '{BASELINE}'),
trial AS (SELECT -1 AS place, NULL::VARCHAR AS candidate, NULL::DOUBLE AS score, NULL::DOUBLE AS previous, FALSE AS accepted, (SELECT score FROM means WHERE method = '{BASELINE}') AS best, 0 AS since, 0 AS n
  UNION ALL SELECT c.place, c.candidate, c.score, t.best, c.score - t.best > 0.01, CASE WHEN c.score - t.best > 0.01 THEN c.score ELSE t.best END, CASE WHEN c.score - t.best > 0.01 THEN 0 ELSE t.since + 1 END, t.n + 1
  FROM trial t JOIN cands c ON c.place = t.place + 1 WHERE t.n < 4 AND NOT (t.n >= 2 AND t.since >= 2)),
trials AS (SELECT place, candidate, score, previous, accepted FROM trial WHERE place >= 0)"""
_REQUESTS = """WITH raw AS (SELECT event_id AS pos, event_type AS alias, user_id AS task, CAST(props->>'$.k' AS BIGINT) AS k, value, event_id % 2 = 0 AS even FROM events),
counts AS (SELECT *, CASE WHEN k % 13 <> 0 THEN k * 2 END AS i, CAST(floor(value) AS BIGINT) AS o, CASE WHEN k % 3 = 0 THEN k ELSE 0 END AS t FROM raw),
requests AS (SELECT pos, alias, task, k, k + 100 AS reserved_tokens, CASE WHEN alias = 'error' THEN 'unknown' WHEN k % 10 = 0 THEN 'active' ELSE 'settled' END AS status, i IS NOT NULL AND i >= 0 AND o >= 0 AS ok,
  CASE WHEN i >= 0 AND o >= 0 THEN i END AS input_tokens, CASE WHEN i >= 0 AND o >= 0 THEN o END AS output_tokens, CASE WHEN i >= 0 AND o >= 0 THEN greatest(t, i + o) END AS total_tokens,
  CASE WHEN i >= 0 AND o >= 0 THEN CASE WHEN k <= i THEN k ELSE 0 END END AS cached_input_tokens, CASE WHEN i >= 0 AND o >= 0 THEN CAST(CASE WHEN 4 <= o THEN 4 ELSE 0 END AS BIGINT) END AS reasoning_output_tokens FROM counts)"""
_RUNS = """runs AS (SELECT *, CASE last WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status
  FROM (SELECT user_id % 24 AS run, arg_max(event_type, event_id) AS last, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS jobs, max(event_id) AS modified FROM events GROUP BY 1))"""
_Q = lambda x: "TRUE" if x is True else "FALSE" if x is False else f"'{x}'" if isinstance(x, str) else str(x)
_DAG = """stages AS (SELECT o_orderkey AS stage, o_custkey AS project, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS place,
  ['artifact', 'literature_cards', 'tabular_experiment', 'proposal', 'freeze'][o_orderkey % 5 + 1] AS adapter, CASE WHEN o_orderkey % 11 = 0 THEN 'holdout' ELSE 'development' END AS split,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'proposal' WHEN '2-HIGH' THEN 'freeze' WHEN '3-MEDIUM' THEN 'literature' WHEN '4-NOT SPECIFIED' THEN 'interpretation' END AS role, o_totalprice >= 60000 AS review,
  CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE ['awaiting_review', 'failed', 'stale'][o_orderkey % 3 + 1] END AS status,
  CAST(o_orderkey % 4 AS INT) AS attempts, 3 AS max_attempts, starts_with(o_orderpriority, '1') AS paid FROM orders),
edges AS (SELECT stage, needs FROM (SELECT o_orderkey AS stage, unnest([lag(o_orderkey, 1) OVER w, lag(o_orderkey, 2) OVER w]) AS needs FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE needs IS NOT NULL),
up(stage, ancestor) AS (SELECT stage, needs FROM edges UNION SELECT u.stage, e.needs FROM up u JOIN edges e ON e.stage = u.ancestor)"""
_BLOCKED = "SELECT e.stage FROM edges e JOIN stages n ON n.stage = e.needs WHERE n.status <> 'accepted'"
_TAB = "WITH tab AS (SELECT l.doc_id AS id, n_chars / 1000.0::DOUBLE AS x, quality::DOUBLE AS y FROM labels l JOIN documents d USING (doc_id))"
_RE2 = lambda p: p.replace("(?<![A-Za-z0-9_])", "(^|[^A-Za-z0-9_])")  # noqa: E731  its engine looks at no place behind


_RECORDED = f"""WITH RECURSIVE {_DAG}, line AS (SELECT l_orderkey AS stage, l_shipdate < TIMESTAMP '2001-01-01' AS early, CAST(l_linenumber AS BIGINT) || ':' || l_partkey || ':' || CAST(l_quantity AS BIGINT) AS x,
  CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END AS back FROM lineitem),
held AS (SELECT stage, coalesce(string_agg(x, ',' ORDER BY x) FILTER (early), '') AS was, string_agg(x, ',' ORDER BY x) AS now, count(*) FILTER (early) AS n_was, count(*) AS n_now, sum(back) AS back FROM line GROUP BY stage),
rec AS (SELECT s.*, '{{"adapter": "' || adapter || '", "config": {{"lines": ' AS head, '}}, "id": ' || s.stage || '}}' AS tail, coalesce(n_was, 0) AS n_was, coalesce(n_now, 0) AS n_now,
  sha256(coalesce(was, '')) AS old_input, sha256(coalesce(now, '')) AS input, sha256(adapter) AS fingerprint, sha256(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)) AS result,
  sha256(CAST(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) - coalesce(back, 0) AS DECIMAL(18, 2)) AS VARCHAR)) AS found
  FROM stages s JOIN orders o ON o.o_orderkey = s.stage LEFT JOIN held h ON h.stage = s.stage),
direct AS (SELECT e.stage, string_agg('"' || e.needs || '": "' || n.result || '"', ', ' ORDER BY CAST(e.needs AS VARCHAR)) AS needs, bool_and(n.status = 'accepted') AS open FROM edges e JOIN rec n ON n.stage = e.needs GROUP BY e.stage),
form AS (SELECT r.*, coalesce(open, true) AS open, '{{"adapter": "' || fingerprint || '", "dependencies": {{' || coalesce(needs, '') || '}}, "engine": "1", "inputs": {{"lines": "' AS one,
  '"}}, "stage": "' || replace(head || n_now || tail, '"', chr(92) || '"') || '"}}' AS two FROM rec r LEFT JOIN direct d ON d.stage = r.stage)"""


def queries() -> dict:
    named = (dag_ancestors, grid_results, grid_complete, grid_summary, grid_outcomes, same_data_check, search_fold, holdout_methods, holdout_claims, audit_diff, usage_normalized, ledger_rollup, admission_fold, request_cache, ledger_latest, settle_reservations, recent_requests, feed_top80, board_totals, grid_progress, runs_by_time, alerts_union, run_errors, first_runs, grids_in_order, ledger_faults, planned_anti, ui_filter, dag_signatures, dag_stale, dag_revision, dag_unreviewed, dag_status, dag_retries, dag_decisions, run_resumes, job_reuse, manifest_build, manifest_diff, evidence_gate, dedupe_blobs, redact, secret_scan, share_scan, locate_excerpt, json_pointer, evidence_calc, tex_escape, path_rules, stratified_sample, hash_shuffle, tabular_threshold, tabular_linear, comparison, split_overlap, unique_ids, proposal_dupes)
    dags = {"dag_order": L.out_of_order, "dag_blockers": L.blockers, "dag_runnable": L.runnable, "dag_unfrozen": L.unfrozen_holdouts, "dag_leaks": L.leaks}
    return {f.__name__: f for f in named} | {k: _dag(f) for k, f in dags.items()}


def oracle_sql() -> dict[str, str]:
    tex = "url"
    for a, b in (("\\", "\x01"), *((c, f"\\{c}") for c in "&%$#_{}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\x01", r"\textbackslash{}")):
        tex = f"replace({tex}, {'chr(1)' if a == chr(1) else _Q(a)}, {'chr(1)' if b == chr(1) else _Q(b)})"
    _redacted = "text"
    for p in (*T.REDACTED, *SECRETS):
        _redacted = f"regexp_replace({_redacted}, '{p}', '[REDACTED]', 'g')"
    man = "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents"
    return {
        "holdout_claims": _GRID + f", per AS (SELECT r.method, r.seed AS uid, r.metric - b.metric AS delta FROM results r JOIN results b ON b.seed = r.seed AND b.method = '{BASELINE}' WHERE r.seed >= 12 AND r.method <> '{BASELINE}')"
        + weights_sql("per", "method", ("delta",), 2000, 20260929) + " SELECT method, n, mean, round(ms[CAST(floor(len(ms) * 49 / 2000) AS BIGINT) + 1], 9) AS low, round(ms[CAST(floor(len(ms) * 1949 / 2000) AS BIGINT) + 1], 9) AS high FROM orders_of",
        "grid_results": _GRID + " SELECT method, seed, round(metric, 9) AS metric, dataset_sha256 FROM results",
        "grid_complete": _GRID + " SELECT m.method, s.seed, r.seed IS NOT NULL AS done FROM (SELECT DISTINCT method FROM results) m, (SELECT DISTINCT task % 24 AS seed FROM events2) s LEFT JOIN (SELECT * FROM results WHERE NOT (method = 'events_only' AND seed % 7 = 3)) r ON r.method = m.method AND r.seed = s.seed",
        "grid_summary": _SUMMARY + " SELECT method, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(delta_mean, 9) AS delta_mean, round(delta_sd, 9) AS delta_sd FROM summary",
        "grid_outcomes": _SUMMARY + " SELECT method, CASE WHEN round(delta_mean, 9) > 0 THEN 'improved' WHEN round(delta_mean, 9) < 0 THEN 'worsened' ELSE 'matched' END AS outcome, printf('%.6f', round(mean, 9)) AS mean, (CASE WHEN round(delta_mean, 9) < 0 THEN '-' ELSE '+' END) || printf('%.6f', abs(round(delta_mean, 9))) AS delta FROM summary",
        "same_data_check": _GRID + " SELECT seed, count(h) = 0 OR (count(h) = count(*) AND count(DISTINCT h) = 1) AS ok FROM (SELECT seed, CASE WHEN seed = 7 THEN NULL WHEN seed = 5 AND method = 'fifo_memory' THEN repeat('0', 64) WHEN seed = 6 AND method = 'keyed_memory' THEN NULL ELSE dataset_sha256 END AS h FROM results) GROUP BY seed",
        "search_fold": _SEARCH + " SELECT * FROM trials",
        "holdout_methods": _SEARCH + f", inc AS (SELECT coalesce(arg_max(candidate, place) FILTER (accepted), '{BASELINE}') AS incumbent FROM trials), listed AS (SELECT m, min(p) AS p FROM (SELECT unnest(['{BASELINE}', incumbent, 'fifo_memory', 'events_only']) AS m, unnest([0, 1, 2, 3]) AS p FROM inc) GROUP BY m) SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INT) AS place, m AS method FROM listed",
        "audit_diff": _SEARCH + " SELECT place, candidate, accepted, 'recomputed' AS side FROM trials WHERE place = 0 UNION ALL SELECT place, candidate, NOT accepted, 'recorded' FROM trials WHERE place = 0",
        "usage_normalized": _REQUESTS + " SELECT pos, input_tokens, output_tokens, total_tokens, cached_input_tokens, reasoning_output_tokens FROM requests",
        "ledger_rollup": _REQUESTS + """, models(alias, "limit") AS (VALUES ('click', 200000), ('view', 100000), ('purchase', 1000000), ('error', 90000), ('spare', 500)),
per AS (SELECT alias, """ + ", ".join(f"sum(coalesce({c}, 0)) FILTER (status = 'settled') AS {n}" for c, n in (("total_tokens", "reported"), ("input_tokens", "input"), ("output_tokens", "output"), ("cached_input_tokens", "cached"), ("reasoning_output_tokens", "reasoning"))) + """,
 sum(reserved_tokens) FILTER (status <> 'settled') AS held, count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (status = 'settled') AS n_settled, count(*) FILTER (status = 'unknown') AS n_unknown,
 max(CAST(status = 'settled' AND coalesce(total_tokens, 0) > reserved_tokens AS INT)) AS blocked FROM requests GROUP BY alias)
SELECT m.alias, CAST("limit" AS BIGINT) AS "limit", """ + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("reported", "input", "output", "cached", "reasoning", "held", "n_active", "n_settled", "n_unknown")) + """, coalesce(blocked, 0) AS blocked,
 CAST(greatest(0, "limit" - coalesce(reported, 0) - coalesce(held, 0)) AS BIGINT) AS remaining FROM models m LEFT JOIN per USING (alias)""",
        "admission_fold": _REQUESTS.replace("WITH", "WITH RECURSIVE", 1) + """, seq AS (SELECT task, (k % 7 + 1)::DOUBLE AS seconds, row_number() OVER (PARTITION BY task ORDER BY pos) AS k FROM requests),
fold AS (SELECT task, CAST(0 AS BIGINT) AS k, 0 AS admitted, 0.0::DOUBLE AS used, 0 AS refused FROM (SELECT DISTINCT task FROM seq)
  UNION ALL SELECT f.task, s.k, f.admitted + CAST(f.admitted < 20 AND f.used + s.seconds <= 60 AS INT), f.used + CASE WHEN f.admitted < 20 AND f.used + s.seconds <= 60 THEN s.seconds ELSE 0 END, f.refused + CAST(NOT (f.admitted < 20 AND f.used + s.seconds <= 60) AS INT) FROM fold f JOIN seq s ON s.task = f.task AND s.k = f.k + 1)
SELECT task, arg_max(admitted, k) AS admitted, arg_max(used, k) AS used, arg_max(refused, k) AS refused FROM fold GROUP BY task""",
        "request_cache": _REQUESTS + ", c AS (SELECT alias, coalesce(bool_or(status = 'settled') OVER (PARTITION BY alias, k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS reused FROM requests) SELECT alias, count(*) AS n, count(*) FILTER (reused) AS reused FROM c GROUP BY alias",
        "ledger_latest": _REQUESTS + " SELECT pos % 1000 AS id, arg_max(status, pos) AS status, arg_max(reserved_tokens, pos) AS reserved_tokens, count(*) AS states FROM requests GROUP BY 1",
        "settle_reservations": _REQUESTS + " SELECT task, CAST(sum(coalesce(CASE WHEN status = 'settled' THEN total_tokens END, reserved_tokens)) AS BIGINT) AS charged, count(*) FILTER (status = 'settled' AND total_tokens > reserved_tokens) AS overruns FROM requests GROUP BY task",
        "recent_requests": _REQUESTS + " SELECT alias, pos, CAST(row_number() OVER (PARTITION BY alias ORDER BY pos DESC) AS INT) AS rn, status, reserved_tokens FROM requests QUALIFY row_number() OVER (PARTITION BY alias ORDER BY pos DESC) <= 30",
        "feed_top80": """SELECT id, event, owner FROM (SELECT ts AS time, event_id AS id, event_type AS event, 'run-' || (user_id % 24) AS owner FROM events
  UNION ALL SELECT o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END, NULL FROM orders
  UNION ALL SELECT ts, event_id, CASE WHEN event_type = 'error' THEN 'model_usage_unknown' WHEN CAST(props->>'$.k' AS BIGINT) % 10 = 0 THEN 'model_started' ELSE 'model_completed' END, event_type FROM events
  UNION ALL SELECT l_shipdate, l_orderkey, 'stage_shipped', 'project-' || l_suppkey FROM lineitem) ORDER BY time DESC, id DESC, event DESC, owner DESC LIMIT 80""",
        "board_totals": f"WITH {_RUNS} SELECT count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, CAST(sum(jobs) AS BIGINT) AS jobs, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (status IN ('running', 'searching', 'evaluating_holdout', 'writing', 'requesting')) AS active, count(*) FILTER (status = 'pending') AS pending FROM runs",
        "grid_progress": "SELECT user_id % 24 AS run, count(DISTINCT event_type) * count(DISTINCT k % 5) AS total, count(*) FILTER (event_type = 'purchase') AS completed, CAST(sum(k % 3 + 1) AS BIGINT) AS attempts FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) GROUP BY 1",
        "runs_by_time": f"WITH {_RUNS} SELECT run, status, CAST(row_number() OVER (ORDER BY modified DESC) AS INT) AS place FROM runs",
        "alerts_union": _REQUESTS.replace("WITH", "WITH RECURSIVE", 1) + f""", {_RUNS}, {_DAG}
SELECT 'unsettled usage' AS alert, alias AS of, count(*) AS n FROM requests WHERE status = 'unknown' GROUP BY alias
UNION ALL SELECT 'unreadable usage', alias, count(*) FROM requests WHERE NOT ok GROUP BY alias
UNION ALL SELECT 'last request failed', alias, 1 FROM requests GROUP BY alias HAVING arg_max(status, pos) = 'unknown'
UNION ALL SELECT 'failed run', 'run-' || run, 1 FROM runs WHERE status = 'failed'
UNION ALL SELECT 'wrong length', source, count(*) FROM documents WHERE length(text) <> n_chars GROUP BY source
UNION ALL SELECT 'stage', project || '/' || status, count(*) FROM stages WHERE status IN ('awaiting_review', 'failed', 'stale') GROUP BY project, status
UNION ALL SELECT 'project without record', CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
        "run_errors": "SELECT run, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS first FROM (SELECT user_id % 24 AS run, event_id, row_number() OVER (PARTITION BY user_id % 24 ORDER BY event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 5 GROUP BY run",
        "first_runs": f"WITH {_RUNS} SELECT run, status FROM runs WHERE status IN ('failed', 'running', 'pending') AND contains(lower('Runs/RUN-' || run), 'run-1') ORDER BY modified DESC LIMIT 3",
        "grids_in_order": "SELECT name, CAST(row_number() OVER (ORDER BY name = 'holdout', name) AS INT) AS place FROM (SELECT CASE WHEN n_nationkey = 7 THEN 'holdout' ELSE lower(n_name) END AS name FROM nation)",
        "ledger_faults": _REQUESTS + """ SELECT id, pos, before, status FROM (SELECT pos // 10 AS id, pos, status, lag(status) OVER (PARTITION BY pos // 10 ORDER BY pos) AS before FROM requests) WHERE before IN ('settled', 'unknown')""",
        "planned_anti": "SELECT doc_id AS task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "ui_filter": "SELECT page_id FROM pages WHERE contains(lower(to_json(pages)), 'blog.')",
        "dag_signatures": _RECORDED + " SELECT stage, CASE WHEN open THEN sha256(one || input || two) END AS signature FROM form",
        "dag_unreviewed": f"WITH RECURSIVE {_DAG} SELECT stage FROM stages WHERE role IN ('proposal', 'freeze', 'interpretation') AND NOT review",
        "dag_retries": f"WITH RECURSIVE {_DAG} SELECT stage, CASE WHEN status NOT IN ('failed', 'running', 'changes_requested', 'rejected', 'stale') THEN 'status' WHEN split = 'holdout' AND attempts > 0 THEN 'holdout' WHEN attempts >= max_attempts THEN 'attempts' ELSE 'pending' END AS verdict FROM stages",
        "dag_decisions": f"""WITH RECURSIVE {_DAG} SELECT stage, ['accept', 'reject', 'request_changes', 'terminate', 'ignore'][stage % 5 + 1] AS action,
  CASE WHEN stage % 5 = 4 OR stage % 17 = 0 THEN 'incomplete' WHEN status <> 'awaiting_review' THEN 'not under review' WHEN stage % 6 = 0 THEN 'out of date' ELSE ['accepted', 'rejected', 'changes_requested', 'rejected'][stage % 5 + 1] END AS outcome FROM stages""",
        "run_resumes": """SELECT s_suppkey AS run, s_suppkey > 0 AND s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 AND s_suppkey % 5 > 0 AS resumes,
  array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'plan' END, CASE WHEN s_suppkey % 4 = 0 THEN 'script' END, CASE WHEN s_suppkey % 5 = 0 THEN 'engine' END], lambda x: x IS NOT NULL), ',') AS changed FROM supplier""",
        "job_reuse": "SELECT o_orderkey AS job, CASE WHEN o_orderstatus <> 'F' THEN 'run' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'invalidated' ELSE 'reused' END AS action FROM orders",
        "dag_status": f"WITH RECURSIVE {_DAG} SELECT project, CASE WHEN bool_or(status = 'terminated') THEN 'terminated' WHEN bool_and(status = 'accepted') THEN 'completed' WHEN bool_or(status IN ('awaiting_review', 'stale', 'failed', 'running')) THEN 'awaiting' ELSE 'ready' END AS status FROM stages GROUP BY project",
        "dag_ancestors": f"WITH RECURSIVE {_DAG} SELECT DISTINCT stage, ancestor FROM up",
        "dag_order": f"WITH RECURSIVE {_DAG} SELECT e.stage, e.needs FROM edges e JOIN stages s ON s.stage = e.stage LEFT JOIN stages n ON n.stage = e.needs WHERE n.place IS NULL OR n.place >= s.place",
        "dag_blockers": f"WITH RECURSIVE {_DAG} SELECT e.stage, e.needs, n.status FROM edges e JOIN stages n ON n.stage = e.needs WHERE n.status <> 'accepted'",
        "dag_runnable": f"WITH RECURSIVE {_DAG} SELECT stage FROM stages WHERE status = 'pending' AND attempts < max_attempts AND NOT paid AND stage NOT IN ({_BLOCKED})",
        "dag_stale": _RECORDED + """, st(stage) AS (SELECT stage FROM form WHERE status IN ('accepted', 'awaiting_review') AND NOT coalesce(open AND old_input = input AND result = found, false)
  UNION SELECT e.stage FROM st JOIN edges e ON e.needs = st.stage JOIN stages s ON s.stage = e.stage WHERE s.status IN ('accepted', 'awaiting_review')) SELECT stage FROM st""",
        "dag_revision": _RECORDED + """, ch(stage) AS (SELECT stage FROM rec r WHERE n_was <> n_now OR old_input <> input OR (role = 'freeze' AND project IN (SELECT project FROM rec WHERE n_was <> n_now))
  UNION SELECT e.stage FROM ch JOIN edges e ON e.needs = ch.stage) SELECT stage, CASE WHEN stage IN (SELECT stage FROM ch) THEN 'pending' ELSE status END AS status FROM stages""",
        "dag_unfrozen": f"WITH RECURSIVE {_DAG} SELECT stage FROM stages WHERE split = 'holdout' AND stage NOT IN (SELECT e.stage FROM edges e JOIN stages n ON n.stage = e.needs WHERE n.role = 'freeze' AND n.review)",
        "dag_leaks": f"WITH RECURSIVE {_DAG} SELECT stage FROM stages WHERE role IN ('proposal', 'literature') AND stage IN (SELECT u.stage FROM up u JOIN stages a ON a.stage = u.ancestor WHERE a.split = 'holdout')",
        "manifest_build": man,
        "manifest_diff": f"""WITH a AS (SELECT path, bytes, CASE WHEN CAST(path AS BIGINT) % 89 = 1 THEN 'bad' ELSE sha256 END AS s FROM ({man})), b AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS s FROM (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 101 <> 5))
SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.s IS NULL THEN 'unlisted' WHEN NOT regexp_full_match(a.s, '[0-9a-f]{{64}}') THEN 'malformed' WHEN b.s IS NULL THEN 'missing' WHEN a.bytes <> b.bytes OR a.s <> b.s THEN 'changed' ELSE 'ok' END AS state FROM a FULL JOIN b ON a.path = b.path) WHERE state <> 'ok'""",
        "evidence_gate": "WITH c AS (SELECT doc_id AS claim, unnest([doc_id, doc_id + 1, doc_id + 7]) AS ref FROM documents) SELECT claim, CAST(count(*) AS INT) AS n_refs, count(*) FILTER (ref NOT IN (SELECT doc_id FROM documents)) AS missing, count(*) FILTER (ref NOT IN (SELECT doc_id FROM documents)) = 0 AS open FROM c GROUP BY claim",
        "dedupe_blobs": "SELECT sha256(text) AS sha256, min(printf('%012d', doc_id)) AS path, max(CAST(strlen(text) AS BIGINT)) AS bytes, count(*) AS copies FROM documents GROUP BY 1",
        "redact": f"SELECT doc_id, sha256({_redacted}) AS redacted_sha256 FROM documents WHERE regexp_matches(text, '{'|'.join((*T.REDACTED, *SECRETS))}')",
        "secret_scan": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS finding FROM documents WHERE {c}" for n, c in (*((n, f"regexp_matches(text, '{_RE2(p)}')") for n, p in FINDINGS), ("too large", f"strlen(text) > {LARGE}"))),
        "share_scan": f"""WITH f AS (SELECT doc_id, text, lang, CASE WHEN n_chars > 9000 THEN source || '.ZIP' WHEN n_chars < 150 THEN '.env.example' WHEN n_chars < 300 THEN '.env' ELSE source || '.txt' END AS name FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(list_filter([CASE WHEN lang IN ('de', 'es') THEN 'private path' END, CASE WHEN name = '.env' THEN 'credential file' END, CASE WHEN strlen(text) > 5000000 OR lower(name) LIKE '%.zip' THEN 'large/binary artifact' END,
  CASE WHEN {" OR ".join(f"regexp_matches(text, '{_RE2(p)}')" for p in T.CREDENTIALS)} THEN 'possible credential' END], lambda x: x IS NOT NULL)) AS finding FROM f""",
        "locate_excerpt": "SELECT doc_id, item_id, CAST(instr(d.text, b.text) - 1 AS INT) AS place FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
        "json_pointer": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
        "evidence_calc": "SELECT event_id, CASE WHEN event_type = 'view' THEN 'identity' ELSE 'difference' END AS op, round(CASE WHEN event_type = 'view' THEN CAST(props->>'$.k' AS DOUBLE) ELSE value - CAST(props->>'$.k' AS DOUBLE) END, 9) AS result FROM events",
        "tex_escape": f"SELECT page_id, {tex} AS url FROM pages",
        "path_rules": r"SELECT page_id, NOT regexp_matches(p, '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') AND p <> '' AS safe FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '../' || t WHEN page_id % 7 = 0 THEN '/' || t ELSE t END AS p FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS t FROM pages))",
        "stratified_sample": "SELECT lang, doc_id, CAST(row_number() OVER w AS INT) AS rn FROM documents WINDOW w AS (PARTITION BY lang ORDER BY sha256('20260930:' || doc_id), doc_id) QUALIFY row_number() OVER w <= 20",
        "hash_shuffle": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('v5-order:' || doc_id)) AS INT) AS place FROM documents",
        "tabular_threshold": _TAB + " SELECT p, round(avg(CAST((x >= p) = (y <> 0) AS INT)), 9) AS score, count(*) AS n FROM tab, (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS p) GROUP BY p",
        "tabular_linear": _TAB + " SELECT p, round(avg(pow(p * x - y, 2)), 6) AS score, count(*) AS n FROM tab, (SELECT unnest([0.1, 0.25, 0.5]::DOUBLE[]) AS p) GROUP BY p",
        "comparison": _TAB + """, s AS (SELECT p, CASE WHEN id % 4 = 0 THEN 'holdout' ELSE 'development' END AS split, avg(CAST((x >= p) = (y <> 0) AS INT)) AS score, count(*) AS n FROM tab, (SELECT unnest([0.5, 2.0]::DOUBLE[]) AS p) WHERE p < 1 OR id % 4 > 0 OR id % 5 > 0 GROUP BY ALL)
SELECT sha256('labels:' || a.n) AS dataset_sha256, 'accuracy' AS metric, 'maximize' AS direction, a.split, a.n, round(a.score, 9) AS before, round(b.score, 9) AS after, round(b.score - a.score, 9) AS gain, b.score - a.score > 0 AS improved FROM s a JOIN s b ON a.p = 0.5 AND b.p = 2.0 AND a.split = b.split AND a.n = b.n""",
        "split_overlap": _TAB + " SELECT id FROM tab WHERE id % 3 = 0 INTERSECT SELECT id FROM tab WHERE id % 5 = 0",
        "unique_ids": _TAB + " SELECT id % 97 AS id, count(*) AS n FROM tab GROUP BY 1 HAVING count(*) > 1",
        "proposal_dupes": "SELECT event_id AS pos, sha256(event_type || '|' || props) AS fingerprint, CAST(row_number() OVER w AS INT) AS nth FROM events WINDOW w AS (PARTITION BY event_type || '|' || props ORDER BY event_id) QUALIFY row_number() OVER w > 1",
    }

"""Queries over event streams with bounded memories; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import records as R
from ..sources import tables as S

#: Families of traces.
FAMILIES = ("steady", "update", "revoke", "conflict", "resolve", "replay")


def _answers(kept, events):
    found = kept.select("task", "key", F.col("value").alias("predicted"))
    return M.truth(events).join(found, ["task", "key"], "left").select("task", "key", "expected", "predicted")


def mem_recent(spark, d):
    e = S.keyed_events(spark, d)
    return _answers(M.recent(e), e)


def mem_events_only(spark, d):
    e = S.keyed_events(spark, d)
    return _answers(M.recent(e, keyed_only=True), e)


def mem_keyed(spark, d):
    e = S.keyed_events(spark, d)
    return _answers(M.keyed(e), e)


def mem_fifo(spark, d):
    e = S.keyed_events(spark, d)
    return _answers(M.bounded_map(e), e)


def mem_first_write(spark, d):
    e = S.keyed_events(spark, d)
    return _answers(M.bounded_map(e, keep_first=True), e)


def sim_metrics(spark, d):
    """Accuracy and size of the record-bounded memories."""
    e, out = S.keyed_events(spark, d), None
    kinds = (("recent_window", M.recent(e)), ("events_only", M.recent(e, keyed_only=True)), ("keyed_memory", M.keyed(e)), ("fifo_memory", M.bounded_map(e)), ("first_write", M.bounded_map(e, keep_first=True)))
    for name, kept in kinds:
        out = _answers(kept, e).withColumn("method", F.lit(name)) if out is None else out.unionByName(_answers(kept, e).withColumn("method", F.lit(name)))
    # what a task retains, as compact JSON: pairs of key and value
    held = F.sum(F.octet_length("key") + F.length(F.col("predicted").cast("string")) + 6)
    hits = F.sum(F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).cast("int"))
    per = out.groupBy("method", "task").agg(hits.alias("correct"), F.count("*").alias("total"), F.count("predicted").alias("records"), F.coalesce(held + 1, F.lit(2)).alias("bytes"))
    m = per.groupBy("method").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.sum("records").alias("records"), F.avg("records").alias("mean_records"), F.avg("bytes").alias("mean_bytes"))
    return m.select("*", (F.col("correct") / F.col("total")).alias("accuracy"))


def mem_oracle(spark, d):
    return M.oracle(S.memory_events(spark, d)).select("task", "key", "expected", F.size("active").alias("n_active"), F.size("history").alias("n_history"))


def mem_event_window(spark, d):
    return M.read_window(S.memory_events(spark, d))


def _policy(name):
    def run(spark, d):
        e = S.memory_events(spark, d)
        return M.read(M.retain_all(e, (name,)), M.asked(e), name)

    return run


def mem_source_jvm(spark, d):
    """The fold as an expression inside the JVM."""
    e = S.memory_events(spark, d)
    return M.read(M.retain(e, "source"), M.asked(e), "source")


def _judged(spark, d):
    e = S.memory_events(spark, d)
    out = M.read(M.retain_all(e), M.asked(e))
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("task") % len(FAMILIES) + 1).cast("int"))
    return M.judged(out, e).withColumn("family", family)


def mem_stale(spark, d):
    return _judged(spark, d).filter("stale").select("policy", "budget", "task", "key", "predicted", "expected")


def _rounded(df, keys):
    return df.select(*keys, *(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


def mem_metrics(spark, d):
    return _rounded(M.metrics(_judged(spark, d), ("policy", "budget")), ("policy", "budget"))


def mem_family_metrics(spark, d):
    return _rounded(M.metrics(_judged(spark, d), ("policy", "budget", "family")), ("policy", "budget", "family"))


def dataset_identity(spark, d):
    """One digest of the event lists of all tasks, whatever order rows are read in."""
    return R.tree_identity(S.memory_events(spark, d), ("task", "pos"))


_EVENTS = """events5 AS (SELECT user_id // 2 AS task, event_id AS pos, CASE WHEN event_type <> 'error' THEN 'P' ELSE 'R' END AS op,
  'k' || (CAST(props->>'$.k' AS INT) % 12) AS key, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, CAST(floor(value) AS INT) % 5 + 1 AS version,
  CASE WHEN event_type <> 'error' THEN 'x' || event_id END AS value FROM events)"""
_KEYED = """events2 AS (SELECT user_id AS task, event_id AS pos, CASE WHEN event_type <> 'view' THEN 'k' || (CAST(props->>'$.k' AS INT) % 16) END AS key,
  CASE WHEN event_type <> 'view' THEN event_id END AS value FROM events),
truth AS (SELECT task, key, max(value) AS expected FROM events2 WHERE key IS NOT NULL GROUP BY ALL)"""


def _kept(name: str) -> str:
    """A relation kept_<name>(task, key, predicted)."""
    last = "SELECT task, key, arg_max(value, pos) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY pos DESC) AS rn FROM events2 %s) WHERE rn <= 8 AND key IS NOT NULL GROUP BY ALL"
    simple = {
        "recent": last % "",
        "events_only": last % "WHERE key IS NOT NULL",
        "keyed": "SELECT task, key, predicted FROM (SELECT task, key, arg_max(value, pos) AS predicted, row_number() OVER (PARTITION BY task ORDER BY max(pos) DESC) AS rn FROM events2 WHERE key IS NOT NULL GROUP BY task, key) WHERE rn <= 8",
    }
    if name in simple:
        return f"kept_{name} AS ({simple[name]})"
    held = "list_contains(list_transform(f.rows, lambda r: r.key), s.key)"
    new = "[{'key': s.key, 'value': s.value}]"
    if name == "fifo":
        grown = f"CASE WHEN {held} THEN list_transform(f.rows, lambda r: CASE WHEN r.key = s.key THEN {{'key': s.key, 'value': s.value}} ELSE r END) ELSE f.rows || {new} END"
    else:
        grown = f"list_filter(f.rows, lambda r: r.key <> s.key) || CASE WHEN {held} THEN list_filter(f.rows, lambda r: r.key = s.key) ELSE {new} END"
    return f"""seq_{name} AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY pos) AS k FROM events2 WHERE key IS NOT NULL),
fold_{name} AS (SELECT task, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(key VARCHAR, value BIGINT)[]) AS rows FROM (SELECT DISTINCT task FROM events2)
  UNION ALL SELECT task, k, CASE WHEN len(g) > 8 THEN g[2:] ELSE g END FROM (SELECT f.task, s.k, {grown} AS g FROM fold_{name} f JOIN seq_{name} s ON s.task = f.task AND s.k = f.k + 1)),
kept_{name} AS (SELECT task, r.key AS key, r.value AS predicted FROM (SELECT task, unnest(arg_max(rows, k)) AS r FROM fold_{name} GROUP BY task))"""


def _kept_sql(name: str) -> str:
    return f"WITH RECURSIVE {_KEYED}, {_kept(name)} SELECT t.task, t.key, t.expected, k.predicted FROM truth t LEFT JOIN kept_{name} k USING (task, key)"


_ANSWER = "CASE len(list_distinct(%s)) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN list_distinct(%s)[1] ELSE 'CONFLICT' END"


def _oracle_sql(events: str, name: str, by: str = "task") -> str:
    return f"""{name}_tops AS (SELECT *, max(version) OVER (PARTITION BY {by}, key, source) AS top FROM {events}),
{name}_src AS (SELECT {by}, key, source, bool_or(version = top AND op = 'R') AS revoked, arg_max(value, pos) FILTER (version = top AND op = 'P') AS v, list(value) FILTER (op = 'P') AS puts FROM {name}_tops GROUP BY {by}, key, source),
{name} AS (SELECT {by}, key, {_ANSWER % ('vals', 'vals')} AS expected, list_distinct(vals) AS active, list_distinct(puts) AS history
  FROM (SELECT {by}, key, coalesce(list(v) FILTER (NOT revoked AND v IS NOT NULL), []) AS vals, flatten(list(coalesce(puts, []))) AS puts FROM {name}_src GROUP BY {by}, key))"""


def _policy_sql(name: str) -> str:
    """Relations ending in read_<name>(task, budget, key, predicted, bytes, peak)."""
    p = M.POLICIES[name]
    source = "'*'" if p.collapse else "s.source"
    same = f"r.key = s.key AND r.source = {source}"
    old = f"list_filter(f.rows, lambda r: {same})[1]"
    refused = ["(s.op = 'R' AND s.version < o.version)"]
    if p.versions:
        refused.append("s.version < o.version OR (s.version = o.version AND o.value IS NULL AND s.op = 'P')")
    refuse = f"(o IS NOT NULL AND ({' OR '.join(refused)}))" + (" OR s.op = 'R'" if not p.revoke else "")
    value = "CASE WHEN s.op = 'P' THEN s.value END"
    size = f"CAST(strlen(s.key) + strlen({source}) + length(CAST(s.version AS VARCHAR)) + coalesce(strlen({value}) + 2, 4) + 9 AS INT)"
    new = f"[{{'pos': s.pos, 'key': s.key, 'source': {source}, 'version': s.version, 'value': {value}, 'size': {size}}}]"
    total = lambda rows: f"(CASE WHEN len({rows}) = 0 THEN 2 ELSE 1 + list_sum(list_transform({rows}, lambda r: r.size + 1)) END)"
    order = "list_filter(g, lambda r: r.value IS NOT NULL) || list_filter(g, lambda r: r.value IS NULL)" if p.protect else "g"
    tail = "list_sort(q[d + 1:])" if p.protect else "q[d + 1:]"
    both = " OR len(list_distinct(list_transform(m, lambda r: r.source))) < 2" if p.both_sources else ""
    kind = "STRUCT(pos BIGINT, key VARCHAR, source VARCHAR, version INT, value VARCHAR, size INT)[]"
    return f"""seq_{name} AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY pos) AS k FROM events5),
fold_{name} AS (SELECT task, unnest([384, 768, 1536]) AS budget, CAST(0 AS BIGINT) AS k, CAST([] AS {kind}) AS rows, 2 AS peak FROM (SELECT DISTINCT task FROM events5)
  UNION ALL SELECT task, budget, k, rows, greatest(peak, CAST({total('rows')} AS INT)) FROM (
    SELECT task, budget, k, peak, {tail} AS rows FROM (
      SELECT *, list_filter(range(0, len(q) + 1), lambda d: (CASE WHEN d = len(q) THEN 2 ELSE 1 + list_sum(list_transform(q[d + 1:], lambda r: r.size + 1)) END) <= budget)[1] AS d FROM (
        SELECT task, budget, k, peak, {order} AS q FROM (
          SELECT f.task, f.budget, s.k, f.peak, CASE WHEN coalesce({refuse}, FALSE) THEN f.rows ELSE list_filter(f.rows, lambda r: NOT ({same})) || {new} END AS g
          FROM (SELECT f.*, s.k AS nk, {old} AS o FROM fold_{name} f JOIN seq_{name} s ON s.task = f.task AND s.k = f.k + 1) f JOIN seq_{name} s ON s.task = f.task AND s.k = f.nk))))),
state_{name} AS (SELECT task, budget, arg_max(rows, k) AS rows, arg_max(peak, k) AS peak FROM fold_{name} GROUP BY task, budget),
read_{name} AS (SELECT task, budget, key, CASE WHEN len(m) = 0{both} THEN 'ABSTAIN' ELSE {_ANSWER % (('list_filter(list_transform(m, lambda r: r.value), lambda v: v IS NOT NULL)',) * 2)} END AS predicted, CAST(bytes AS INT) AS bytes, peak
  FROM (SELECT s.task, s.budget, q.key, list_filter(s.rows, lambda r: r.key = q.key) AS m, {total('s.rows')} AS bytes, s.peak FROM state_{name} s JOIN (SELECT DISTINCT task, key FROM events5) q USING (task)))"""


def _judged_sql() -> str:
    every = " UNION ALL ".join(f"SELECT '{n}' AS policy, * FROM read_{n}" for n in M.POLICIES)
    family = ", ".join(f"'{f}'" for f in FAMILIES)
    return f"""WITH RECURSIVE {_EVENTS}, {', '.join(_policy_sql(n) for n in M.POLICIES)}, {_oracle_sql('events5', 'orc')},
judged AS (SELECT a.*, o.expected, list_contains(o.history, a.predicted) AND NOT list_contains(o.active, a.predicted) AS stale, [{family}][a.task % 6 + 1] AS family FROM ({every}) a JOIN orc o USING (task, key))"""


def _metrics_sql(keys: str) -> str:
    rate = lambda case, hit, name: f"round(count(*) FILTER ({case} AND {hit}) / greatest(1, count(*) FILTER ({case}))::DOUBLE, 9) AS {name}"
    hit = "predicted = expected"
    return f"""{_judged_sql()} SELECT {keys}, {rate('TRUE', hit, 'accuracy')}, {rate('TRUE', 'stale', 'stale_rate')}, {rate('TRUE', "predicted = 'ABSTAIN'", 'abstain_rate')},
  {rate("expected NOT IN ('UNKNOWN', 'CONFLICT')", hit, 'concrete_recall')}, {rate("expected = 'UNKNOWN'", hit, 'unknown_accuracy')}, {rate("expected = 'CONFLICT'", hit, 'conflict_accuracy')},
  {rate("expected = 'CONFLICT'", "predicted NOT IN ('UNKNOWN', 'CONFLICT', 'ABSTAIN')", 'false_concrete_conflict_rate')}, round(avg(bytes), 9) AS mean_bytes, max(peak) AS max_bytes, count(*) AS total FROM judged GROUP BY {keys}"""


_SIMS = (("recent_window", "recent"), ("events_only", "events_only"), ("keyed_memory", "keyed"), ("fifo_memory", "fifo"), ("first_write", "first_write"))


def queries() -> dict:
    named = (mem_recent, mem_events_only, mem_keyed, mem_fifo, mem_first_write, sim_metrics, mem_oracle, mem_event_window, mem_stale, mem_metrics, mem_family_metrics, mem_source_jvm, dataset_identity)
    return {f.__name__: f for f in named} | {f"mem_{n}": _policy(n) for n in M.POLICIES}


def oracle_sql() -> dict[str, str]:
    sims = " UNION ALL ".join(f"SELECT '{m}' AS method, task, key, t.expected, k.predicted FROM truth t LEFT JOIN kept_{k} k USING (task, key)" for m, k in _SIMS)
    window = f"""WITH {_EVENTS}, sized AS (SELECT *, 1 + sum(strlen(key) + strlen(source) + length(CAST(version AS VARCHAR)) + coalesce(strlen(value) + 2, 4) + 12 + strlen(op) + 1) OVER (PARTITION BY task ORDER BY pos DESC) AS total FROM events5),
fit AS (SELECT * FROM (SELECT *, unnest([384, 768, 1536]) AS budget FROM sized) WHERE total <= budget), {_oracle_sql('fit', 'orc', 'task, budget')}
SELECT q.task, q.budget, q.key, coalesce(o.expected, 'ABSTAIN') AS predicted FROM (SELECT *, unnest([384, 768, 1536]) AS budget FROM (SELECT DISTINCT task, key FROM events5)) q LEFT JOIN orc o USING (task, budget, key)"""
    return {
        **{f"mem_{n}": _kept_sql(n) for n in ("recent", "events_only", "keyed", "fifo", "first_write")},
        "sim_metrics": f"""WITH RECURSIVE {_KEYED}, {', '.join(_kept(k) for _, k in _SIMS)},
per AS (SELECT method, task, count(*) FILTER (predicted = expected) AS correct, count(*) AS total, count(predicted) AS records, coalesce(sum(strlen(key) + length(CAST(predicted AS VARCHAR)) + 6) + 1, 2) AS bytes FROM ({sims}) GROUP BY method, task)
SELECT method, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total, CAST(sum(records) AS BIGINT) AS records, avg(records) AS mean_records, avg(bytes) AS mean_bytes, sum(correct) / sum(total)::DOUBLE AS accuracy FROM per GROUP BY method""",
        "mem_oracle": f"WITH {_EVENTS}, {_oracle_sql('events5', 'orc')} SELECT task, key, expected, CAST(len(active) AS INT) AS n_active, CAST(len(history) AS INT) AS n_history FROM orc",
        "mem_event_window": window,
        **{f"mem_{n}": f"WITH RECURSIVE {_EVENTS}, {_policy_sql(n)} SELECT * FROM read_{n}" for n in M.POLICIES},
        "mem_source_jvm": f"WITH RECURSIVE {_EVENTS}, {_policy_sql('source')} SELECT * FROM read_source",
        "mem_stale": _judged_sql() + " SELECT policy, budget, task, key, predicted, expected FROM judged WHERE stale",
        "mem_metrics": _metrics_sql("policy, budget"),
        "mem_family_metrics": _metrics_sql("policy, budget, family"),
        "dataset_identity": f"""WITH {_EVENTS}, leaf AS (SELECT row_number() OVER (ORDER BY task, pos) - 1 AS place, sha256('{{"key": "' || key || '", "op": "' || op || '", "pos": ' || pos || ', "source": "' || source || '", "task": ' || task || ', "value": ' || coalesce('"' || value || '"', 'null') || ', "version": ' || version || '}}') AS digest FROM events5),
one AS (SELECT place // 100 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM leaf GROUP BY place // 100),
two AS (SELECT place // 100 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM one GROUP BY place // 100),
three AS (SELECT place // 100 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM two GROUP BY place // 100)
SELECT (SELECT count(*) FROM leaf) AS n, CASE WHEN (SELECT count(*) FROM one) = 1 THEN (SELECT any_value(digest) FROM one) WHEN (SELECT count(*) FROM two) = 1 THEN (SELECT any_value(digest) FROM two) ELSE (SELECT any_value(digest) FROM three) END AS sha256""",
    }

"""Streaming queries, run over all that a table holds; and their batch SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import generate as G
from ..operators import memory as M
from ..sources import tables as S
from ..streaming import feeds, ledger, memory
from . import memory as PM
from . import records as PR


def _events(spark, d):
    return S.versioned(feeds.table_stream(spark, d, "events"))


def _retained(policy):
    def run(spark, d):
        rows = feeds.run_to_end(memory.retain_stream(_events(spark, d), policy, 768))
        return feeds.newest_state(rows, "task").select("task", "rows", "bytes", "peak")

    return run


def stream_ledger(spark, d):
    e = feeds.table_stream(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "error", "unknown").when(k % 10 == 0, "active").otherwise("settled")
    rows = feeds.run_to_end(feeds.ledger_rollup_stream(e.select(F.col("event_type").alias("alias"), (k + 100).alias("reserved_tokens"), status.alias("status"))))
    return feeds.newest_state(rows, "alias")


#: Tokens that a route of the streamed ledger may use.
ROUTE_LIMIT = 400


def request_log(e):
    """Each user's events as the log of a route: clicks reserve, views report progress, purchases and errors finish the
    request reserved last, errors without usage."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    op = F.when(kind == "click", "reserve").when(kind == "view", "progress").otherwise("finish")
    last = F.coalesce(F.max(F.when(kind == "click", F.col("event_id"))).over(by), F.lit(-1))
    amount = F.when(kind == "click", k % 50 + 40).when(kind == "purchase", F.floor("value").cast("long"))
    return e.select(F.col("user_id").cast("string").alias("route"), F.row_number().over(by).cast("long").alias("pos"), op.alias("op"), last.alias("request"), amount.alias("amount"))


def stream_lifecycle(spark, d):
    """The log of requests, shuffled and in part sent twice, over several micro-batches."""
    log, folder = request_log(S.table(spark, d, "events")), feeds.stream_folder(spark)
    again = log.filter("pos % 7 = 0").withColumn("sent", F.lit(1))
    log.withColumn("sent", F.lit(0)).union(again).repartition(6, F.xxhash64("route", "pos", "sent")).drop("sent").write.parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return feeds.run_to_end(ledger.lifecycle_stream(stream, ROUTE_LIMIT), "append").drop("batch")


def stream_feed(spark, d):
    """The newest 80 rows of all feeds, as streams."""
    feed = PR.feed_of(lambda name: feeds.table_stream(spark, d, name))
    return feeds.newest_of(feeds.run_to_end(feeds.newest_stream(feed))).drop("time")


def stream_windows(spark, d):
    rows = feeds.run_to_end(feeds.windowed_counts(feeds.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "update")
    last = rows.groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n")


def _customers(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("task"))


def generated_traces(spark, d):
    """A versioned trace for each customer, and its labels under the batch rule: each family gives its own."""
    e = G.versioned_traces(_customers(spark, d), 7)
    return M.oracle(e, ("family", "task")).filter("key = 'k0'").groupBy("family", "expected").agg(F.count("*").alias("n"))


def generated_episodes(spark, d):
    """An episode for each customer: its keys, and how many of them a bounded memory still holds."""
    e = G.keyed_episodes(_customers(spark, d), 7)
    return PM._answers(M.keyed(e), e).groupBy("task").agg(F.count("*").alias("keys"), F.count("predicted").alias("held"))


def queries() -> dict:
    return {"stream_mem_source": _retained("source"), "stream_mem_protected": _retained("protected"), **{f.__name__: f for f in (stream_ledger, stream_lifecycle, stream_feed, stream_windows, generated_traces, generated_episodes)}}


def oracle_sql() -> dict[str, str]:
    state = lambda n: f"WITH RECURSIVE {PM._EVENTS}, {PM._policy_sql(n)} SELECT task, CAST(len(rows) AS INT) AS rows, CAST(CASE WHEN len(rows) = 0 THEN 2 ELSE 1 + list_sum(list_transform(rows, lambda r: r.size + 1)) END AS INT) AS bytes, peak FROM state_{n} WHERE budget = 768"
    return {
        "stream_mem_source": state("source"),
        "stream_mem_protected": state("protected"),
        "stream_ledger": "SELECT event_type AS alias, count(*) AS n, CAST(sum(CASE WHEN event_type <> 'error' AND k % 10 <> 0 THEN 0 ELSE k + 100 END) AS BIGINT) AS held, count(*) FILTER (event_type <> 'error' AND k % 10 <> 0) AS settled FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY 1",
        "generated_traces": """WITH t AS (SELECT ['steady', 'update', 'revoke', 'conflict', 'resolve', 'replay'][c_custkey % 6 + 1] AS family FROM customer),
moves(family, source, op, version, value, step) AS (VALUES ('update', 'a', 'P', 2, 'B', 0), ('update', 'b', 'P', 2, 'B', 1), ('revoke', 'a', 'R', 1, NULL, 0), ('revoke', 'b', 'R', 1, NULL, 1), ('conflict', 'a', 'P', 2, 'B', 0),
  ('resolve', 'a', 'P', 2, 'B', 0), ('resolve', 'b', 'P', 2, 'B', 1), ('replay', 'a', 'P', 2, 'B', 0), ('replay', 'b', 'P', 2, 'B', 1), ('replay', 'a', 'P', 1, 'A', 2), ('replay', 'b', 'P', 1, 'A', 3)),
ev AS (SELECT * FROM moves UNION ALL SELECT DISTINCT family, unnest(['a', 'b']), 'P', 1, 'A', -1 FROM t),
top AS (SELECT *, max(version) OVER (PARTITION BY family, source) AS top FROM ev),
src AS (SELECT family, source, bool_or(op = 'R' AND version = top) AS revoked, arg_max(value, step) FILTER (op = 'P' AND version = top) AS value FROM top GROUP BY ALL),
act AS (SELECT family, coalesce(list_distinct(list(value) FILTER (NOT revoked AND value IS NOT NULL)), []) AS v FROM src GROUP BY family)
SELECT family, CASE len(v) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN v[1] ELSE 'CONFLICT' END AS expected, count(*) AS n FROM t JOIN act USING (family) GROUP BY ALL""",
        "generated_episodes": """WITH e AS (SELECT c_custkey AS task, pos FROM customer, range(72) AS r(pos)), u AS (SELECT task, pos, CAST('0x' || substr(md5('7:' || task || ':' || pos || ':key'), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS k,
  CAST('0x' || substr(md5('7:' || task || ':' || pos || ':kind'), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS kind FROM e)
SELECT task, count(DISTINCT floor(k * 16)) AS keys, least(8, count(DISTINCT floor(k * 16))) AS held FROM u WHERE kind < 0.65 GROUP BY task""",
        "stream_feed": PR.oracle_sql()["feed_top80"],
        "stream_lifecycle": f"""WITH RECURSIVE e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
log AS (SELECT CAST(user_id AS VARCHAR) AS route, row_number() OVER w AS pos, CASE event_type WHEN 'click' THEN 'reserve' WHEN 'view' THEN 'progress' ELSE 'finish' END AS op, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END) OVER w, -1) AS request,
  CASE event_type WHEN 'click' THEN k % 50 + 40 WHEN 'purchase' THEN CAST(floor(value) AS BIGINT) END AS amount FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
run(route, pos, op, request, outcome, used, held, blocked, status, reserved) AS (
  SELECT DISTINCT route, 0::BIGINT, '', 0::BIGINT, '', 0::BIGINT, 0::BIGINT, false, NULL::VARCHAR, 0::BIGINT FROM log
  UNION ALL
  SELECT route, pos, op, request, outcome, CASE WHEN outcome IN ('settled', 'overrun') THEN used + amount ELSE used END,
    CASE WHEN outcome = 'reserved' THEN held + amount WHEN outcome IN ('settled', 'overrun') THEN held - reserved ELSE held END, blocked OR outcome = 'overrun',
    CASE outcome WHEN 'reserved' THEN 'active' WHEN 'refused' THEN NULL WHEN 'unknown usage' THEN 'unknown' WHEN 'settled' THEN 'settled' WHEN 'overrun' THEN 'settled' ELSE status END,
    CASE WHEN outcome = 'reserved' THEN amount ELSE reserved END
  FROM (SELECT l.*, r.used, r.held, r.blocked, r.status, r.reserved, CASE WHEN l.op = 'reserve' THEN CASE WHEN r.blocked OR {ROUTE_LIMIT} - r.used - r.held < l.amount THEN 'refused' ELSE 'reserved' END WHEN r.status IS NULL THEN 'unknown request'
      WHEN l.op = 'progress' THEN 'progress' WHEN r.status <> 'active' THEN 'already settled' WHEN l.amount IS NULL THEN 'unknown usage' WHEN l.amount > r.reserved THEN 'overrun' ELSE 'settled' END AS outcome
    FROM run r JOIN log l ON l.route = r.route AND l.pos = r.pos + 1))
SELECT route, pos, op, request, outcome, used, held, blocked FROM run WHERE pos > 0""",
        "stream_windows": "SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    }

"""Queries that write files to the shared folder and read them again; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files
from ..sources import tables as S
from ..sources.shared import shared_folder


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# ------------------------------------------------ files
def file_lines(spark, d):
    """Parts written as JSON lines and read again."""
    path = _folder(spark)
    files.write_json(S.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    files.append_events(S.table(spark, d, "part").select(F.lit("t").alias("time"), (-F.col("p_partkey") - 1).alias("p_partkey"), "p_name"), path)
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double, time string").json(path)


def file_csv(spark, d):
    """Order totals as the summary file of a run."""
    path = _folder(spark)
    o = S.table(spark, d, "orders")
    rows = o.select(F.col("o_orderstatus").alias("method"), F.col("o_custkey").alias("seed"), F.col("o_totalprice").alias("metric"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("result_path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    files.write_summary(rows, path)
    read = spark.read.option("header", True).schema("method string, seed long, metric double, result_path string, sha256 string").csv(path)
    return read


def file_event_tail(spark, d):
    """The last lines of a log of all events, some of them broken."""
    path = _folder(spark)
    e = S.table(spark, d, "events")
    line = F.to_json(F.struct(F.concat(F.lit("t"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("time"), F.col("event_type").alias("event")))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line)
    e.select("event_id", broken.alias("value")).repartitionByRange(1, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return files.tail_events(spark, path, "run").select("owner", "time", "event")


def _state_files(spark, d) -> str:
    """A file of its own for each nation: a state document, of which some are broken."""
    path = _folder(spark)
    n = S.table(spark, d, "nation")
    doc = F.to_json(F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") * 3).alias("jobs")))
    broken = F.when(F.col("n_nationkey") % 4 == 0, F.substring(doc, 1, 9)).otherwise(doc)
    n.select(broken.alias("value"), F.col("n_nationkey").alias("k")).repartition(25, "k").write.partitionBy("k").text(path)
    return path


def _key(path):
    return F.regexp_extract(path, r"/k=(\d+)/", 1).cast("long").alias("k")


def file_states(spark, d):
    """State documents of all files, and warnings for those that can't be read."""
    good, bad = files.scan_states(spark, f"{_state_files(spark, d)}/k=*/*.txt", "name string, jobs long")
    return good.select(_key("path"), "name", "jobs").unionByName(bad.select(_key("path"), "warning"), allowMissingColumns=True)


def file_previews(spark, d):
    return files.preview(spark, f"{_state_files(spark, d)}/k=*/*.txt", 20).select(_key("path"), "text", "truncated")


def file_manifests(spark, d):
    m = files.file_manifest(spark, _state_files(spark, d), "*.txt")
    return m.select(F.regexp_extract("path", r"^k=(\d+)/", 1).cast("long").alias("k"), "bytes", "sha256")


def file_sizes(spark, d):
    """Files that are small enough to be read."""
    return files.small_files(spark, f"{_state_files(spark, d)}/k=*/*.txt", 30).select(_key("path"), "length")


def file_snapshot(spark, d):
    """Content of the part types, once for each digest."""
    path = _folder(spark)
    files.snapshot(S.table(spark, d, "part").select(F.encode("p_type", "UTF-8").alias("content")), path)
    return spark.read.parquet(path).select("sha256", F.decode("content", "UTF-8").alias("text"))


def file_attempts(spark, d):
    """Execution records of each region's nations, found by their path, and what they took."""
    path = _folder(spark)
    failed = F.when(F.col("n_nationkey") % 5 == 0, "failed").otherwise("completed")
    records = S.table(spark, d, "nation").select("n_regionkey", F.struct(failed.alias("status"), (F.col("n_nationkey") * 0.25).alias("wall_seconds"), F.lit(60.0).alias("timeout_seconds")).alias("r"))
    for run in range(5):
        own = records.filter(F.col("n_regionkey") == run).agg(F.to_json(F.collect_list("r")).alias("value"))
        own.write.text(f"{path}/runs/r{run}/jobs/j/attempt_1/execution.json")
    return files.resources(files.attempts(spark, path))


def file_export(spark, d):
    """The documents' texts as an export, read again and verified against its manifest."""
    path = _folder(spark)
    texts = S.table(spark, d, "documents").filter("text IS NOT NULL").select(F.format_string("texts/%09d.txt", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    files.export(texts, path, r"texts/[0-9]+\.txt")
    return files.exported(spark, path)


def response_frames(spark, d):
    """Each user's events as a streamed response: views and purchases are data, clicks end frames, some errors the stream."""
    e = S.table(spark, d, "events")
    kind = F.col("event_type")
    line = F.when(kind == "click", "").when(kind == "view", F.concat(F.lit("data: "), "props")).when(kind == "purchase", F.concat(F.lit("data:"), F.col("event_id").cast("string"), F.lit("\r")))
    line = line.when(F.col("value") > 90, "data: [DONE]").otherwise(": keep-alive")
    return files.response_frames(e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), line.alias("line")), 1500)


_DOCS = """docs AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN left(doc, 9) ELSE doc END || chr(10) AS t, n_nationkey % 4 > 0 AS ok, n_name AS name, n_nationkey * 3 AS jobs
  FROM (SELECT *, '{"name":"' || n_name || '","jobs":' || (n_nationkey * 3) || '}' AS doc FROM nation))"""


def queries() -> dict:
    named = (file_lines, file_csv, file_event_tail, file_states, file_previews, file_manifests, file_sizes, file_snapshot, file_attempts, file_export, response_frames)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "file_lines": "SELECT p_partkey, p_name, p_retailprice, NULL::VARCHAR AS time FROM part UNION ALL SELECT -p_partkey - 1, p_name, NULL, 't' FROM part",
        "file_csv": "SELECT o_orderstatus AS method, o_custkey AS seed, o_totalprice AS metric, 'orders/' || o_orderkey AS result_path, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders",
        "file_event_tail": "SELECT 'run' AS owner, 't' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS time, event_type AS event FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 100 AND event_id % 7 > 0",
        "file_states": f"WITH {_DOCS} SELECT k, CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN jobs END AS jobs, CASE WHEN NOT ok THEN 'unreadable record' END AS warning FROM docs",
        "file_previews": f"WITH {_DOCS} SELECT k, left(t, 20) AS text, length(t) > 20 AS truncated FROM docs",
        "file_manifests": f"WITH {_DOCS} SELECT k, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM docs",
        "file_sizes": f"WITH {_DOCS} SELECT k, CAST(strlen(t) AS BIGINT) AS length FROM docs WHERE strlen(t) <= 30",
        "file_snapshot": "SELECT DISTINCT sha256(p_type) AS sha256, p_type AS text FROM part",
        "file_export": "SELECT 'texts/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, 'ok' AS state FROM documents WHERE text IS NOT NULL",
        "file_attempts": "SELECT count(*) AS attempts, count(*) FILTER (n_nationkey % 5 = 0) AS failed, sum(n_nationkey * 0.25::DOUBLE) AS wall_seconds, sum(60.0::DOUBLE) AS reserved_seconds FROM nation",
        "response_frames": """WITH l AS (SELECT user_id AS stream, event_id AS pos, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'data: ' || props WHEN 'purchase' THEN 'data:' || event_id ELSE CASE WHEN value > 90 THEN 'data: [DONE]' ELSE ': keep-alive' END END AS line,
  CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS ends FROM events),
f AS (SELECT *, count(*) FILTER (line = '') OVER (PARTITION BY stream ORDER BY pos) - CAST(line = '' AS INT) AS frame FROM l),
g AS (SELECT stream, frame, string_agg(ltrim(substr(line, 6)), chr(10) ORDER BY pos) FILTER (starts_with(line, 'data:')) AS payload, sum(strlen(line) + ends) AS bytes FROM f GROUP BY ALL),
h AS (SELECT *, coalesce(count(*) FILTER (payload = '[DONE]') OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM g),
t AS (SELECT *, sum(bytes) OVER (PARTITION BY stream) AS total FROM h WHERE ended = 0)
SELECT stream, frame, payload FROM t WHERE payload IS NOT NULL AND payload <> '[DONE]' AND total <= 1500 UNION ALL SELECT DISTINCT stream, NULL, NULL FROM t WHERE payload IS NOT NULL AND payload <> '[DONE]' AND total > 1500""",
    }

"""Files in and out: JSON documents, JSON lines, CSV, previews, manifests, content-addressed snapshots, response frames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .shared import delete

EVENT = "time string, event string, job string, candidate string, decision string, status string, error string, method string"
METADATA_BYTES = 8 << 20
PREVIEW_CHARS = 250_000
TAIL_BYTES, TAIL_LINES = 65_536, 100


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Whole-file JSON documents, one row each (or one for each element of an array); a byte order mark is skipped."""
    reader = spark.read.option("multiLine", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in a new folder, all or nothing; non-finite numbers are refused."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(F.isnan(name) | (F.abs(name) == float("inf")), F.raise_error(F.lit(f"{name} isn't finite")).cast(kind)).otherwise(F.col(name)))
    df.write.mode("errorifexists").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends rows to a folder of JSON lines; a missing time is the present one, in UTC."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamped = df.withColumn("time", F.coalesce("time", now)) if "time" in df.columns else df.withColumn("time", now)
    stamped.write.mode("append").json(path)


def _ends(size: int):
    """The last bytes of each file, read where the task runs; nothing else of it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inside = FileSystem.from_uri(path)
                with fs.open_input_file(inside) as file:
                    tails.append(file.read_at(size, max(0, length - size)).decode("utf8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails, pa.string())], ["path", "tail"])

    return run


def tail_events(spark: SparkSession, path: str, owner: str | None = None, lines: int = TAIL_LINES, size: int = TAIL_BYTES) -> DataFrame:
    """The last lines of each event log, from its last `size` bytes; malformed lines are skipped, the known fields kept.
    The driver only lists the logs, with their lengths."""
    logs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ends = logs.mapInArrow(_ends(size), "path string, tail string")
    last = F.filter(F.split("tail", "\r?\n"), lambda x: x != "")
    rows = ends.select("path", F.explode(F.slice(last, F.greatest(F.size(last) - lines + 1, F.lit(1)), lines)).alias("line"))
    parsed = rows.select("path", F.from_json("line", EVENT, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("line").isNotNull().alias("ok"))
    return parsed.filter("ok").select("path", F.lit(owner).alias("owner"), "r.*")


def scan_states(spark: SparkSession, pattern: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """State documents of all files that match, and the paths of those that can't be read."""
    raw = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    good = F.try_parse_json("value").isNotNull()
    states = raw.filter(good).select("path", F.from_json("value", schema).alias("s")).select("path", "s.*")
    return states, raw.filter(~good).select("path", F.lit("unreadable record").alias("warning"))


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """Execution records below root: path, status, wall_seconds, timeout_seconds."""
    return read_json(spark, f"{root}/runs/*/jobs/*/attempt_*/execution.json", "status string, wall_seconds double, timeout_seconds double").withColumn("path", F.input_file_name())


def resources(records: DataFrame) -> DataFrame:
    """Attempts, failures, wall seconds, and seconds reserved."""
    return records.agg(F.count("*").alias("attempts"), F.count_if(F.col("status") != "completed").alias("failed"), F.sum(F.coalesce("wall_seconds", F.lit(0.0))).alias("wall_seconds"), F.sum(F.coalesce("timeout_seconds", F.lit(0.0))).alias("reserved_seconds"))


def write_summary(df: DataFrame, path: str) -> None:
    df.select("method", "seed", "metric", "result_path", "sha256").write.mode("errorifexists").option("header", True).csv(path)


def small_files(spark: SparkSession, pattern: str, limit: int = METADATA_BYTES) -> DataFrame:
    """Files of up to limit bytes; larger ones are left out before they are read."""
    return spark.read.format("binaryFile").load(pattern).filter(F.col("length") <= limit)


#: Suffixes of files that may be shown.
SHOWN = ("csv", "json", "jsonl", "log", "md", "py", "tex", "txt")


def preview(spark: SparkSession, pattern: str, limit: int = PREVIEW_CHARS) -> DataFrame:
    """path, redacted beginning of the text, and whether more follows, of files with an allowed suffix."""
    shown = small_files(spark, pattern).filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*SHOWN))
    text = shown.select("path", F.decode("content", "UTF-8").alias("t"))
    return text.select("path", T.redact(F.substring("t", 1, limit)).alias("text"), (F.length("t") > limit).alias("truncated"))


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (relative to root), bytes, sha256, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    plain = re.sub(r"^[a-z]+:/*(?=/)", "", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_extract("path", r"^[a-z]+:/*(/.*)$", 1), "^" + re.escape(plain) + "/", "")
    return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def snapshot(files: DataFrame, path: str) -> None:
    """Content once for each digest. files: content (binary)."""
    digest = files.select("content", F.sha2("content", 256).alias("sha256"))
    digest.dropDuplicates(["sha256"]).write.mode("errorifexists").partitionBy("sha256").parquet(path)


def export(entries: DataFrame, path: str, allowed: str) -> None:
    """Writes entries (path, content) and a manifest of their sizes and digests, all or nothing. Paths that don't match
    `allowed` as a whole, lead upwards, are absolute or stand twice are refused before anything is written. Both parts are
    written beside `path`, and one rename makes the export visible; what a failure leaves is deleted."""
    spark = entries.sparkSession
    entries = entries.select("path", "content")
    inside = F.col("path").rlike(rf"\A(?:{allowed})\z") & ~F.col("path").rlike(r"(\A|/)\.\.?(/|\z)|\A/|//|\\")
    bad = entries.groupBy("path").agg(F.count("*").alias("n")).filter(~F.coalesce(inside, F.lit(False)) | (F.col("n") > 1))
    if refused := [r["path"] for r in bad.limit(20).collect()]:
        raise ValueError(f"refused: {refused}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} is there already")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        entries.write.parquet(f"{staged}/entries")
        written = spark.read.parquet(f"{staged}/entries")
        manifest = written.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        manifest.write.json(f"{staged}/manifest")
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
            raise OSError(f"{staged} can't become {path}")
    finally:
        delete(spark, staged)


def exported(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, state of an export's entries: ok, changed, missing, or unlisted."""
    listed = spark.read.schema("path string, bytes long, sha256 string").json(f"{path}/manifest")
    found = spark.read.parquet(f"{path}/entries").select(F.col("path").alias("p"), F.octet_length("content").cast("long").alias("b"), F.sha2("content", 256).alias("s"))
    both = listed.join(found, F.col("path") == F.col("p"), "full")
    state = F.when(F.col("p").isNull(), "missing").when(F.col("path").isNull(), "unlisted").when((F.col("bytes") == F.col("b")) & (F.col("sha256") == F.col("s")), "ok").otherwise("changed")
    return both.select(F.coalesce("path", "p").alias("path"), F.coalesce("bytes", "b").alias("bytes"), F.coalesce("sha256", "s").alias("sha256"), state.alias("state"))


#: Fixed value: bytes of a response from which it is refused.
RESPONSE_BYTES = 16 << 20


def response_frames(lines: DataFrame, limit: int = RESPONSE_BYTES) -> DataFrame:
    """stream, frame (from 0), payload: a stream's frames up to its end mark. Of a frame, which a blank line ends, the
    `data:` lines count, joined by line feeds. lines: stream, pos, line. A stream of more than `limit` bytes up to its end
    mark is refused as a whole: its only row has a null frame. So no window holds more than that of a stream that counts."""
    by = Window.partitionBy("stream").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    plain = F.regexp_replace("line", r"[\r\n]+\z", "")
    cut_lines = lines.select("stream", "pos", plain.alias("line"), (F.octet_length("line") + 1).alias("bytes"))
    # what comes after the limit can't be read any more, but one line tells that it is there
    cut_lines = cut_lines.withColumn("so_far", F.coalesce(F.sum("bytes").over(before), F.lit(0))).filter(F.col("so_far") <= limit)
    numbered = cut_lines.withColumn("frame", F.coalesce(F.sum((F.col("line") == "").cast("int")).over(before), F.lit(0)))
    data = F.when(F.startswith("line", F.lit("data:")), F.regexp_replace(F.expr("substring(line, 6)"), r"(?U)\A[\s\x1c-\x1f]+", ""))
    frames = numbered.groupBy("stream", "frame").agg(F.sort_array(F.collect_list(F.when(data.isNotNull(), F.struct("pos", data.alias("x"))))).alias("parts"), F.sum("bytes").alias("bytes"))
    frames = frames.withColumn("payload", F.array_join("parts.x", "\n"))
    turns = Window.partitionBy("stream").orderBy("frame")
    ended = F.coalesce(F.max((F.col("payload") == "[DONE]").cast("int")).over(turns.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = frames.withColumn("ended", ended).filter("ended = 0").withColumn("total", F.sum("bytes").over(Window.partitionBy("stream")))
    live = live.filter("size(parts) > 0 AND payload <> '[DONE]'")
    read = live.filter(F.col("total") <= limit).select("stream", F.col("frame").cast("long").alias("frame"), "payload")
    return read.union(live.filter(F.col("total") > limit).select("stream", F.lit(None).cast("long"), F.lit(None).cast("string")).distinct())

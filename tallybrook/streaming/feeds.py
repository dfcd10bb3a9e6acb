"""Streaming ledgers and feeds, and running a stream over what is there now."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_folder


def stream_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema  # streams don't infer it
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def ledger_rollup_stream(requests: DataFrame) -> DataFrame:
    """alias, n, held, settled over the stream so far (complete or update mode)."""
    done = F.col("status") == "settled"
    return requests.groupBy("alias").agg(F.count("*").alias("n"), F.sum(F.when(done, 0).otherwise(F.col("reserved_tokens"))).alias("held"), F.count_if(done).alias("settled"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type; what comes later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


#: Parts of a feed whose newest rows are kept side by side.
SHARDS = 16


def _newer(row: list) -> tuple:
    """Sorts by time, id, event and owner, nulls as the oldest."""
    return tuple((x is not None, x) if x is not None else (False,) for x in row)


def newest_stream(feed: DataFrame, n: int = 80) -> DataFrame:
    """shard, state: the newest n rows of each shard so far, as JSON. Rows are dealt by a hash of all their fields, and a
    shard's state is a heap of n rows, however long the feed gets."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for batch in batches:
            rows = ([None if pd.isna(x) else x for x in r] for r in zip(batch["time"], batch["id"], batch["event"], batch["owner"], strict=True))
            held = heapq.nlargest(n, [*held, *([t, None if i is None else int(i), e, o] for t, i, e, o in rows)], key=_newer)
        text = json.dumps(held)
        state.update((text,))
        yield pd.DataFrame([(key[0], text)], columns=["shard", "state"])

    named = feed.select("time", "id", "event", "owner")
    dealt = named.withColumn("shard", F.pmod(F.xxhash64("time", "id", "event", "owner"), F.lit(SHARDS)).cast("int"))
    return dealt.groupBy("shard").applyInPandasWithState(run, "shard int, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def newest_of(shards: DataFrame, n: int = 80) -> DataFrame:
    """The newest n rows of all shards; shards: shard, state, batch, of which each shard's last counts."""
    rows = newest_state(shards, "shard").select(F.explode(F.from_json("state", "array<array<string>>")).alias("r"))
    parts = rows.select(F.col("r")[0].alias("time"), F.col("r")[1].cast("long").alias("id"), F.col("r")[2].alias("event"), F.col("r")[3].alias("owner"))
    return parts.orderBy(F.desc("time"), F.desc("id"), F.desc("event"), F.desc("owner")).limit(n)


def run_to_end(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Runs over all that is available; rows carry the micro-batch that made them, in `batch`."""
    spark = stream.sparkSession
    folder = stream_folder(spark)
    out = f"{folder}/out"

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch:06d}-rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("batch", "integer")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def newest_state(rows: DataFrame, key: str) -> DataFrame:
    """Each key's row of the last micro-batch that made one."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(key, "s.*")


def append_feed(stream: DataFrame, path: str, checkpoint: str):
    """Appends the stream to a folder of JSON lines."""
    return stream.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

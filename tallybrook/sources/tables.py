"""Canonical inputs of the operators, read from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, session, turn, role, text: ten conversations make a scenario."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.expr("conv_id DIV 10").alias("uid"), F.col("conv_id").alias("session"), "turn", "role", "text")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: uid, haystack_session (sessions of turns in order)."""
    t = turns(spark, sf_dir)
    session = t.groupBy("uid", "session").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    return session.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("session", "turns"))).alias("haystack_session"))


def unnest(records: DataFrame) -> DataFrame:
    """Sessions, then turns, with their ordinals; ordinals stand before any filter."""
    s = records.select("uid", F.posexplode("haystack_session").alias("si", "s"))
    return s.select("uid", "si", "s.session", F.posexplode("s.turns").alias("ti", "t")).select("uid", "si", "session", "ti", "t.role", F.col("t.content").alias("text"))


def gold(turn_rows: DataFrame) -> DataFrame:
    """uid, type, m_old, m_new, update_session: first sentences of a scenario's first and last user turn."""
    key = F.struct("session", "turn")
    user = turn_rows.filter("role = 'user'").groupBy("uid").agg(F.min_by("text", key).alias("old"), F.max_by("text", key).alias("new"), F.max_by("session", key).alias("update_session"))
    kind = F.concat(F.lit("T"), (F.col("uid") % 2 + 1).cast("string"))
    first = lambda c: F.coalesce(F.get(T.sentences(F.col(c)), F.lit(0)), F.lit(""))
    return user.select("uid", kind.alias("type"), first("old").alias("m_old"), first("new").alias("m_new"), "update_session")


def queries(spark: SparkSession, sf_dir: str, turn_rows: DataFrame | None = None) -> DataFrame:
    """uid, dim, query: a scenario's twelve commonest tokens, and a benchmark text. turn_rows: the turns, if they are there
    already."""
    user = (turns(spark, sf_dir) if turn_rows is None else turn_rows).filter("role = 'user'")
    counted = user.select("uid", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("uid", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("uid").orderBy(F.desc("n"), "term")
    common = counted.withColumn("rn", F.row_number().over(order)).filter("rn <= 12").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rn", "term"))).alias("q"))
    frequent = common.select("uid", F.lit("frequent").alias("dim"), F.array_join("q.term", " ").alias("query"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    # the items are dealt in turn, however many there are; their ids count from 0
    count = items.agg((F.max("item_id") + 1).alias("items"))
    uids = user.select("uid").distinct().crossJoin(F.broadcast(count))
    bench = uids.join(items, F.col("uid") % F.col("items") == F.col("item_id")).select("uid", F.lit("benchmark").alias("dim"), "query")
    return frequent.unionByName(bench)


def versioned(e: DataFrame, keys: int = 12) -> DataFrame:
    """task, pos, op, key, source, version, value of events: versioned puts (P) and revocations (R). Two users, as two
    sources, write to each task, so tasks grow with the users."""
    k = F.get_json_object("props", "$.k").cast("int") % keys
    put = F.col("event_type") != "error"
    return e.select(
        F.expr("user_id DIV 2").alias("task"), F.col("event_id").alias("pos"), F.when(put, "P").otherwise("R").alias("op"), F.concat(F.lit("k"), k.cast("string")).alias("key"),
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("source"), (F.floor("value") % 5 + 1).cast("int").alias("version"),
        F.when(put, F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("value"),
    )


def memory_events(spark: SparkSession, sf_dir: str, keys: int = 12) -> DataFrame:
    return versioned(table(spark, sf_dir, "events"), keys)


def keyed_events(spark: SparkSession, sf_dir: str, keys: int = 16) -> DataFrame:
    """task (a user), pos, key (null: a distractor), value."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % keys
    key = F.when(F.col("event_type") != "view", F.concat(F.lit("k"), k.cast("string")))
    return e.select(F.col("user_id").alias("task"), F.col("event_id").alias("pos"), key.alias("key"), F.when(key.isNotNull(), F.col("event_id")).alias("value"))

import json
import random

from tallybrook.operators import memory as M
from pyspark.sql import functions as F

from tallybrook.operators import records as R
from tallybrook.streaming import feeds, ledger, memory

SCHEMA = "task long, pos long, op string, key string, source string, version int, value string"


def events():
    rng = random.Random(4)
    return [(i % 3, i, op := rng.choice("PPPR"), f"k{rng.randrange(5)}", rng.choice("ab"), rng.randint(1, 3), None if op == "R" else f"x{i}") for i in range(120)]


def test_stream_in_batches_equals_the_fold(spark, tmp_path):
    rows = events()
    for i in range(0, 120, 40):  # each file becomes a micro-batch
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = feeds.newest_state(feeds.run_to_end(memory.retain_stream(stream, "protected", 150)), "task")
    want = M.retain(spark.createDataFrame(rows, SCHEMA), "protected", (150,))
    a = {r["task"]: (r["bytes"], r["peak"], len(json.loads(r["state"]))) for r in got.collect()}
    b = {r["task"]: (r["bytes"], r["peak"], len(r["rows"])) for r in want.collect()}
    assert a == b


def test_feed_appends_json_lines(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, event string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, event string").parquet(str(tmp_path / "in"))
    feeds.append_feed(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["event"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["x"]


LOG = "route string, pos long, op string, request long, amount long"


def in_files(spark, rows, schema, folder, size):
    """A stream of the rows, some at a time."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_requests_live_as_the_log_in_order_says(spark, tmp_path):
    a = [("reserve", 1, 10), ("reserve", 2, 95), ("finish", 1, 5), ("reserve", 2, 95), ("progress", 2, 7), ("finish", 2, 96), ("finish", 2, 96), ("reserve", 3, 1)]
    b = [("finish", 9, None), ("reserve", 1, 5), ("finish", 1, None), ("reserve", 1, 5), ("reserve", 4, 0), ("reserve", 5, 96), ("reserve", 6, 95)]
    want_a = [("reserved", 0, 10, False), ("refused", 0, 10, False), ("settled", 5, 0, False), ("reserved", 5, 95, False), ("progress", 5, 95, False), ("overrun", 101, 0, True), ("already settled", 101, 0, True), ("refused", 101, 0, True)]
    want_b = [("unknown request", 0, 0, False), ("reserved", 0, 5, False), ("unknown usage", 0, 5, False), ("repeated request", 0, 5, False), ("invalid reservation", 0, 5, False), ("refused", 0, 5, False), ("reserved", 0, 100, False)]
    rows = [(r, i + 1, *x) for r, log in (("a", a), ("b", b)) for i, x in enumerate(log)]
    sent = rows + rows[2:12]
    random.Random(3).shuffle(sent)
    got = feeds.run_to_end(ledger.lifecycle_stream(in_files(spark, sent, LOG, str(tmp_path / "in"), 7), 100), "append").collect()
    said = sorted((r["route"], r["pos"], r["outcome"], r["used"], r["held"], r["blocked"]) for r in got)
    assert said == [(r, i + 1, *x) for r, log in (("a", want_a), ("b", want_b)) for i, x in enumerate(log)]
    assert len({r["batch"] for r in got}) > 1


def test_an_entry_waits_for_those_before_it(spark, tmp_path):
    rows = [("a", 3, "reserve", 3, 1), ("a", 2, "reserve", 2, 1), ("a", 5, "reserve", 5, 1), ("a", 1, "reserve", 1, 1)]
    got = feeds.run_to_end(ledger.lifecycle_stream(in_files(spark, rows, LOG, str(tmp_path / "in"), 1), 100), "append")
    assert sorted((r["pos"], r["held"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_the_live_feed_is_the_newest_after_each_batch(spark, tmp_path):
    rng = random.Random(5)
    schema = "time string, id long, event string, owner string"
    rows = [(rng.choice([None, f"t{rng.randrange(30):02d}"]), rng.choice([None, rng.randrange(20)]), rng.choice("ab"), rng.choice([None, "x"])) for _ in range(200)]
    shards = feeds.run_to_end(feeds.newest_stream(in_files(spark, rows, schema, str(tmp_path / "in"), 50), 9))
    for batch in range(shards.agg(F.max("batch")).first()[0] + 1):
        got = list(map(tuple, feeds.newest_of(shards.filter(F.col("batch") <= batch), 9).collect()))
        seen = spark.read.schema(schema).parquet(str(tmp_path / "in")) if batch == 3 else None
        if seen is not None:
            assert got == list(map(tuple, R.newest(seen, 9).collect()))
        assert len(got) == 9

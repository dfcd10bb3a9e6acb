"""Stage graphs: identities, signatures, staleness, revisions, roles."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallybrook.functions.canonical import canonical, identity
from tallybrook.operators import lineage as L

STAGE = "stage string, project string, place int, adapter string, role string, review boolean, split string, status string, attempts int, max_attempts int, paid boolean"


# ------------------------------------------------ canonical JSON
def test_canonical_json_is_that_of_the_encoder(spark):
    rng = random.Random(0)
    texts = ["", "plain", 'a "quote" \\ back', "tab\t\n\r\b\f\x00\x1f\x7f", "é ü 中 \u2028", "😀 𝒳", "~ !"] + ["".join(chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x10FFFF), rng.randrange(32, 127)])) for _ in range(8)) for _ in range(60)]
    rows = [(i, {"z": t, t or "k": None}, [t, None, "x"], (t, i % 2 == 0, [[i], []]), rng.choice([0.1, 1e16, 1e-7, -0.0, 5e-324, 1e22, 2.0**-44, 123456789.123])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n long, m map<string,string>, l array<string>, s struct<Text:string,b:boolean,a:array<array<int>>>, d double")
    df = df.select(F.struct("*").alias("v"))
    kind = df.schema["v"].dataType
    for r in df.select("v", canonical(F.col("v"), kind).alias("text"), identity(F.col("v"), kind).alias("id")).collect():
        value = r["v"].asDict(recursive=True)
        assert r["text"] == json.dumps(value, sort_keys=True) and r["id"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_canonical_json_of_nulls_and_other_types(spark):
    df = spark.sql("SELECT named_struct('b', CAST(NULL AS STRING), 'a', CAST(NULL AS ARRAY<INT>), 'c', NULL) AS v")
    assert df.select(canonical(F.col("v"), df.schema["v"].dataType)).first()[0] == '{"a": null, "b": null, "c": null}'
    with pytest.raises(TypeError):
        canonical(F.lit(1), spark.sql("SELECT DATE '2020-01-01' AS d").schema["d"].dataType)
    bad = spark.sql("SELECT double('inf') AS x")
    with pytest.raises(Exception, match="finite"):
        bad.select(canonical(F.col("x"), bad.schema["x"].dataType)).collect()


# ------------------------------------------------ what a change reaches
def brute(stages, edges):
    """Reached stages: seeds that carry, and what carries and needs one."""
    carries = {s for s, *_, c in stages if c}
    reached = {s for s, _, _, seed, c in stages if seed and c}
    while more := {s for s, n in edges if n in reached and s in carries} - reached:
        reached |= more
    return sorted(reached)


@pytest.mark.parametrize("block", [4, 1000])
def test_downstream_of_random_graphs(spark, block):
    rng = random.Random(block)
    for n in (0, 1, 60):
        stages = [(i, f"p{i % 3}", i // 2, rng.random() < 0.1, rng.random() < 0.8) for i in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(n + 5, 0), (0, n + 7), (n - 1, n // 2)] * 2 if n else []
        df = spark.createDataFrame(stages, "stage long, project string, place int, seed boolean, carries boolean")
        got = L.downstream(df, spark.createDataFrame(edges, "stage long, needs long"), block).collect()
        assert sorted(r["stage"] for r in got) == brute(stages, edges)


def test_a_hundred_thousand_stages_in_a_row(spark):
    n = 100_000
    stages = spark.range(n).select(F.col("id").alias("stage"), F.lit("p").alias("project"), F.col("id").alias("place"), (F.col("id") == 7).alias("seed"), F.lit(True).alias("carries"))
    edges = spark.range(1, n).select(F.col("id").alias("stage"), (F.col("id") - 1).alias("needs"))
    began = time.time()
    assert L.downstream(stages, edges).agg(F.count("*"), F.min("stage")).first()[:] == (n - 7, 7)
    assert time.time() - began < 120


# ------------------------------------------------ signatures
def graph(spark, statuses=("accepted", "accepted", "accepted"), **changed):
    """source, gate and end: each needs the one before."""
    rows = []
    for i, (s, status) in enumerate(zip(("source", "gate", "end"), statuses, strict=True)):
        own = {"spec": f'{{"id": "{s}"}}', "input": "i", "fingerprint": "f", "result": f"r{i}", "found": f"r{i}"} | changed.get(s, {})
        rows.append((s, "p", i, "freeze" if s == "gate" else None, status, own["spec"], {"x": own["input"]}, own["fingerprint"], own["result"], own["found"]))
    stages = spark.createDataFrame(rows, "stage string, project string, place int, role string, status string, spec string, inputs map<string,string>, fingerprint string, result string, found string")
    return stages, spark.createDataFrame([("gate", "source"), ("end", "gate")], "stage string, needs string")


def signed(stages, edges, **how):
    return {r["stage"]: r["signature"] for r in L.signatures(stages, edges, **how).collect()}


def test_signatures_are_identities_of_what_a_result_rests_on(spark):
    got = signed(*graph(spark))
    whole = {"adapter": "f", "dependencies": {"source": "r0"}, "engine": "1", "inputs": {"x": "i"}, "stage": '{"id": "gate"}'}
    assert got["gate"] == hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()
    other = lambda **c: {s for s, v in signed(*graph(spark, **c)).items() if v != got[s]}
    assert other(source={"spec": "{}"}) == {"source"} and other(gate={"input": "j"}) == {"gate"} and other(end={"fingerprint": "g"}) == {"end"}
    assert other(source={"result": "new"}) == {"gate"}
    assert signed(*graph(spark), engine="2").keys() == got.keys() and set(signed(*graph(spark), engine="2").values()).isdisjoint(got.values())
    waiting = signed(*graph(spark, ("accepted", "awaiting_review", "pending")))
    assert waiting["gate"] == got["gate"] and waiting["end"] is None


def gone_stale(spark, statuses, **changed):
    was, edges = graph(spark, statuses)
    now, _ = graph(spark, statuses, **changed)
    return sorted(r["stage"] for r in L.stale(now.join(L.signatures(was, edges), "stage"), edges).collect())


def test_staleness_follows_from_unequal_signatures(spark):
    done = ("accepted",) * 3
    assert gone_stale(spark, done) == []
    assert gone_stale(spark, done, source={"found": "tampered"}) == ["end", "gate", "source"]
    assert gone_stale(spark, done, gate={"spec": "{}"}) == ["end", "gate"]
    assert gone_stale(spark, ("accepted", "awaiting_review", "pending"), source={"input": "j"}) == ["gate", "source"]
    assert gone_stale(spark, ("pending",) * 3, source={"input": "j"}) == []
    assert gone_stale(spark, ("failed", "accepted", "accepted")) == ["end", "gate"]  # a need that isn't accepted


def test_revisions(spark):
    old, edges = graph(spark)
    again = lambda **c: sorted(r["stage"] for r in L.revised(old, graph(spark, **c)[0].select("stage", "spec", "inputs"), edges).collect() if r["status"] == "pending")
    assert again() == [] and again(source={"spec": "{}"}) == ["end", "gate", "source"]
    assert again(end={"input": "j"}) == ["end"]
    assert again(end={"spec": "{}"}) == ["end", "gate"]  # a freeze rests on the whole protocol
    assert again(gate={"result": "new"}) == []


# ------------------------------------------------ roles
def test_what_may_run_and_what_leaks(spark):
    rows = [
        ("sources", "p", 0, "artifact", None, True, "development", "accepted", 1, 2, False), ("idea", "p", 1, "ideas", "proposal", False, "development", "awaiting_review", 1, 2, True),
        ("trial", "p", 2, "tabular_experiment", None, True, "development", "pending", 0, 2, False), ("paid", "p", 3, "tabular_experiment", None, True, "development", "pending", 0, 2, True),
        ("gate", "p", 4, "artifact", "freeze", True, "development", "pending", 9, 2, False), ("loose", "p", 5, "artifact", "freeze", False, "development", "pending", 9, 2, False),
        ("held", "p", 6, "tabular_experiment", None, True, "holdout", "pending", 2, 2, False), ("free", "p", 7, "tabular_experiment", "proposal", True, "holdout", "pending", 2, 2, False),
        ("late", "p", 8, "cards", "literature", True, "development", "pending", 0, 2, False),
    ]
    stages = spark.createDataFrame(rows, STAGE)
    edges = spark.createDataFrame([("trial", "sources"), ("paid", "sources"), ("held", "trial"), ("held", "gate"), ("free", "loose"), ("late", "held"), ("idea", "late")], "stage string, needs string")
    names = lambda df: sorted(r["stage"] for r in df.collect())
    assert names(L.runnable(stages, edges)) == ["trial"] and names(L.runnable(stages, edges, paid=True)) == ["paid", "trial"]
    assert names(L.leaks(stages, edges)) == ["idea", "late"] and names(L.unfrozen_holdouts(stages, edges)) == ["free"]
    assert names(L.unreviewed(stages)) == ["idea", "loose"] and names(L.out_of_order(stages, edges)) == ["idea"]
    assert {r["stage"]: r["verdict"] for r in L.retries(stages.withColumn("status", F.lit("failed"))).collect()}["held"] == "holdout"

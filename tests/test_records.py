import hashlib
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tallybrook.functions import text as T
from tallybrook.operators import excerpts
from tallybrook.operators import lineage as L
from tallybrook.operators import records as R
from tallybrook.plans import records as PR
from tallybrook.sources import files, generate
from tallybrook.sources.shared import shared_folder


def results(spark, rows):
    return spark.createDataFrame(rows, "method string, seed int, metric double, dataset_sha256 string")


def test_paired_delta(spark):
    r = results(spark, [("base", s, 0.8, "x") for s in (1, 2)] + [("m", s, 0.3, "x") for s in (1, 2)])
    assert {x["method"]: round(x["delta_mean"], 9) for x in R.summary(r, "base").collect()} == {"base": 0, "m": -0.5}


def test_same_data(spark):
    r = results(spark, [("a", 1, 0.0, "x"), ("b", 1, 0.0, "y"), ("a", 2, 0.0, None), ("b", 2, 0.0, None), ("a", 3, 0.0, "x"), ("b", 3, 0.0, None)])
    assert {x["seed"]: x["ok"] for x in R.same_data(r).collect()} == {1: False, 2: True, 3: False}


def test_valid_results(spark):
    r = results(spark, [("a", i, m, None) for i, m in enumerate((1.0, float("nan"), float("inf"), None))])
    assert [x["seed"] for x in R.valid_results(r).collect()] == [0]


def search(spark, scores, **how):
    df = spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(scores)], "place int, candidate string, score double")
    return [(t["candidate"], t["accepted"]) for t in R.search(df, F.lit(0.5), **{"threshold": 0.0, "max_trials": 9, "patience": 2, **how}).orderBy("place").collect()]


def test_search(spark):
    assert search(spark, [0.7, 0.9]) == [("c0", True), ("c1", True)]
    assert search(spark, [0.5, 0.4, 0.9]) == [("c0", False), ("c1", False)]  # strict, and patience ends it
    assert search(spark, [0.7, 0.9, 1.0], max_trials=2) == [("c0", True), ("c1", True)]
    assert search(spark, [0.4, 0.6], maximize=False) == [("c0", True), ("c1", False)]


def test_admission(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (1, 1, 10.0), (1, 2, 5.0), (1, 3, 0.1)], "task int, pos int, seconds double")
    r = R.admission(df, 2, 15.0).first()
    assert (r["admitted"], r["used"], r["refused"]) == (2, 15.0, 2)


def test_usage(spark):
    kinds = ("input_tokens", "prompt_tokens", "output_tokens", "completion_tokens", "total_tokens", "cached_input_tokens", "reasoning_output_tokens")
    df = spark.createDataFrame([(10, None, 8, None, 5, 99, 3), (None, None, 8, None, 5, 0, 0), (None, 3, None, -1, None, None, None)], ", ".join(f"{k} long" for k in kinds))
    got = [r["u"] for r in df.select(T.usage(F.struct(*kinds)).alias("u")).collect()]
    assert got[0].asDict() == {"input_tokens": 10, "output_tokens": 8, "total_tokens": 18, "cached_input_tokens": 0, "reasoning_output_tokens": 3} and got[1] is None and got[2] is None


def test_rollup_keeps_idle_models_and_holds_unsettled(spark):
    req = spark.createDataFrame([("a", "unknown", 1100, 0, 0, 0, 0, 0), ("b", "settled", 10, 20, 15, 5, 0, 0)], "alias string, status string, reserved_tokens long, total_tokens long, input_tokens long, output_tokens long, cached_input_tokens long, reasoning_output_tokens long")
    models = spark.createDataFrame([("a", 2000), ("b", 100), ("c", 7)], "alias string, limit long")
    got = {r["alias"]: r for r in R.rollup(req, models).collect()}
    assert (got["a"]["reported"], got["a"]["held"], got["a"]["n_unknown"], got["a"]["remaining"]) == (0, 1100, 1, 900)
    assert got["b"]["blocked"] == 1 and got["c"]["remaining"] == 7


def test_comparison(spark):
    a = spark.createDataFrame([("d", 0.5)], "dataset string, score double")
    b = spark.createDataFrame([("d", 0.75)], "dataset string, score double")
    r = R.compare(a, b, ["dataset"], 0.25).first()
    assert r["gain"] == 0.25 and r["improved"] is False
    assert R.compare(a, b.withColumn("dataset", F.lit("other")), ["dataset"], 0.0).count() == 0


def test_manifest(spark):
    old = spark.createDataFrame([("a", 1, "0" * 64), ("b", 1, "1" * 64), ("c", 1, "bad"), ("d", 1, "2" * 64)], "path string, bytes long, sha256 string")
    new = spark.createDataFrame([("a", 1, "0" * 64), ("b", 2, "1" * 64), ("c", 1, "bad"), ("e", 1, "2" * 64)], "path string, bytes long, sha256 string")
    assert {r["path"]: r["state"] for r in R.manifest_diff(old, new).collect()} == {"a": "ok", "b": "changed", "c": "malformed", "d": "missing", "e": "unlisted"}


def test_short_strata_and_incomplete_grids(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "type string, id long")
    assert R.stratified(rows, "type", "id", 2, "s").count() == 3
    with pytest.raises(ValueError, match="b"):
        R.stratified(rows, "type", "id", 2, "s", strict=True)
    grid = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.5), ("n", 1, 0.5)], "method string, seed int, metric double")
    with pytest.raises(ValueError, match="n"):
        R.summary(grid, "m", strict=True)
    assert R.summary(grid.filter("seed = 1"), "m", strict=True).count() == 2


def test_nothing_follows_a_finished_request(spark):
    log = spark.createDataFrame([(1, 0, "active"), (1, 1, "active"), (1, 2, "settled"), (1, 3, "settled"), (2, 0, "unknown"), (2, 5, "active")], "id int, pos int, status string")
    assert sorted((r["id"], r["pos"]) for r in R.ledger_faults(log).collect()) == [(1, 3), (2, 5)]


def test_places_within_keys_of_any_size(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(500)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(6)
    got = {(r["k"], r["i"]): r["place"] for r in R.numbered_within(df, "k", F.col("i")).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        want |= {(k, i): n + 1 for n, i in enumerate(sorted(i for x, i in rows if x == k))}
    assert got == want


def test_decisions(spark):
    stages = spark.createDataFrame([("a", "awaiting_review", "b1"), ("b", "accepted", "b2")], "stage string, status string, binding string")
    given = [("a", "accept", "me", "fine", "b1"), ("a", "reject", "me", "no", "b1"), ("a", "accept", "me", "fine", "old"), ("b", "accept", "me", "fine", "b2"), ("a", "accept", " ", "fine", "b1"), ("a", "other", "me", "x", "b1"), ("c", "accept", "me", "x", "b")]
    got = [r["outcome"] for r in L.decided(stages, spark.createDataFrame(given, "stage string, action string, actor string, reason string, binding string").coalesce(1)).collect()]
    assert sorted(got) == sorted(["accepted", "rejected", "out of date", "not under review", "incomplete", "incomplete", "not under review"])


@pytest.mark.parametrize("depth", [1, 14, 60])
def test_chains_of_any_depth(spark, depth):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, depth)], "stage long, needs long")
    assert L.ancestors(edges).count() == depth * (depth - 1) // 2


def test_diamonds_and_cycles(spark):
    ladder = [(2 * i + k, 2 * i + j - 2) for i in range(1, 30) for k in (0, 1) for j in (0, 1)]
    assert L.ancestors(spark.createDataFrame(ladder, "stage long, needs long")).count() == sum(2 * 2 * i for i in range(30))
    assert L.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "stage long, needs long")).count() == 9


def closure(edges):
    """All pairs, by walking from each stage."""
    below, pairs = {}, set()
    for s, n in edges:
        below.setdefault(s, set()).add(n)
    for s in below:
        known, todo = set(), list(below[s])
        while todo:
            if (x := todo.pop()) not in known:
                known.add(x)
                todo += below.get(x, ())
        pairs |= {(s, x) for x in known}
    return sorted(pairs)


@pytest.mark.parametrize("stretch", [1, 7, 25, 1000])
def test_ancestors_by_regions(spark, stretch):
    """Cycles, edges given twice, and edges within and between regions of any size; each pair once."""
    rng = random.Random(stretch)
    near = [(i, max(0, i - rng.randrange(1, 4))) for i in range(1, 90) for _ in range(2)]
    edges = near + [(rng.randrange(90), rng.randrange(120)) for _ in range(12)] + [(40, 44), (200, 201), (201, 200), (202, 202)]
    rows = spark.createDataFrame([(f"s{s}", f"s{n}", s // stretch) for s, n in edges], "stage string, needs string, place int").repartition(5)
    got = L.ancestors(rows, ("place",), part=20).collect()
    assert sorted((int(r["stage"][1:]), int(r["ancestor"][1:])) for r in got) == closure(edges)


def test_pairs_of_ancestors_are_not_written(spark, tmp_path):
    size = lambda: sum(p.stat().st_size for p in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())
    spark.range(2000).selectExpr(
        "id AS o_orderkey", "id % 10 AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "TIMESTAMP '2020-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    before = size()
    assert PR.queries()["dag_ancestors"](spark, str(tmp_path)).count() == 10 * 200 * 199 // 2
    assert size() - before < 500_000


def test_event_log_tail(spark, tmp_path):
    log = tmp_path / "events.jsonl"
    log.write_text("\n".join(json.dumps({"time": f"t{i:03d}", "event": "e", "extra": 1}) for i in range(150)) + '\n{"time": "t')
    got = files.tail_events(spark, str(log), "me").collect()
    assert len(got) == 99 and {r["owner"] for r in got} == {"me"} and min(r["time"] for r in got) == "t051"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"x": 1}', encoding="utf8")
    (tmp_path / "b.json").write_text("{broken")
    good, bad = files.scan_states(spark, f"{tmp_path}/*.json", "x int")
    assert [r["x"] for r in good.collect()] in ([1], []) and bad.count() >= 1
    m = files.file_manifest(spark, str(tmp_path), "b.json").collect()
    assert [(r["path"], r["bytes"]) for r in m] == [("b.json", 7)]
    (tmp_path / "t.txt").write_text("key sk-abcdefghijklmnop end")
    assert files.preview(spark, f"{tmp_path}/t.txt").first()["text"] == "key [REDACTED] end"
    files.write_json(spark.createDataFrame([(1.5,)], "x double"), f"{tmp_path}/out")
    assert files.read_json(spark, f"{tmp_path}/out", "x double").first()["x"] == 1.5
    with pytest.raises(Exception, match="finite"):
        files.write_json(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/nan")
    files.append_events(spark.createDataFrame([("start",)], "event string"), f"{tmp_path}/log")
    files.append_events(spark.createDataFrame([("stop",)], "event string"), f"{tmp_path}/log")
    assert {r["event"] for r in spark.read.json(f"{tmp_path}/log").collect()} == {"start", "stop"}
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    files.snapshot(blobs, f"{tmp_path}/blobs")
    assert spark.read.parquet(f"{tmp_path}/blobs").count() == 2


def test_exports_are_whole_and_verified(spark, tmp_path):
    entries = spark.createDataFrame([("a/x.txt", bytearray(b"1")), ("a/y.txt", bytearray(b"22"))], "path string, content binary")
    out = f"{tmp_path}/out"
    files.export(entries, out, r"a/[a-z]+\.txt")
    assert sorted((r["path"], r["bytes"], r["state"]) for r in files.exported(spark, out).collect()) == [("a/x.txt", 1, "ok"), ("a/y.txt", 2, "ok")]
    with pytest.raises(ValueError, match="already"):
        files.export(entries, out, "a/.*")
    for bad in ("b/x.txt", "a/../x.txt", "/a/x.txt", "a/x.txt"):
        more = entries.union(spark.createDataFrame([(bad, bytearray(b"3"))], "path string, content binary"))
        with pytest.raises(ValueError, match="refused"):
            files.export(more, f"{tmp_path}/other", ".*" if bad != "b/x.txt" else "a/.*")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    entries.filter("path = 'a/x.txt'").union(spark.createDataFrame([("a/z.txt", bytearray(b"9"))], "path string, content binary")).write.mode("overwrite").parquet(f"{out}/entries")
    assert {r["path"]: r["state"] for r in files.exported(spark, out).collect()} == {"a/x.txt": "ok", "a/y.txt": "missing", "a/z.txt": "unlisted"}


@pytest.mark.parametrize("n", [0, 1, 7, 10, 11, 250])
def test_one_identity_of_all_rows(spark, n):
    rows = [(i // 3, i, f"é{i}") for i in range(n)]
    level = [hashlib.sha256(json.dumps({"task": t, "pos": i, "v": v}, sort_keys=True).encode()).hexdigest() for t, i, v in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 10]).encode()).hexdigest() for i in range(0, len(level), 10)]
    random.Random(n).shuffle(rows)
    df = spark.createDataFrame(rows, "task long, pos long, v string").repartition(5)
    assert [tuple(r) for r in R.tree_identity(df, ("task", "pos"), 10).collect()] == ([(n, level[0])] if n else [])


def test_frames_of_responses(spark):
    """Several data lines make a frame; the end mark ends a stream, and too many bytes refuse it."""
    streams = {
        1: ["data: {", "data:  1}", "", "event: x", "data: 2", ": ping", "", "", "data: [DONE]", "", "data: late", ""],
        2: ["data: a\r", "\r", "data: b"],
        3: ["data: " + "x" * 100, "", "data: y", ""],
        4: ["data: [DONE]", "", "data: " + "x" * 100],
        5: [": only", ""],
        6: ["data:", ""],
    }
    rows = [(s, i, x) for s, lines in streams.items() for i, x in enumerate(lines)]
    got = files.response_frames(spark.createDataFrame(rows, "stream long, pos int, line string").repartition(5), 90).collect()
    assert sorted(((r["stream"], r["frame"], r["payload"]) for r in got), key=repr) == [(1, 0, "{\n1}"), (1, 1, "2"), (2, 0, "a"), (2, 1, "b"), (3, None, None), (6, 0, "")]


def test_generators_are_stable(spark):
    a, b = (generate.versioned_traces(spark.range(12).withColumnRenamed("id", "task"), 3).orderBy("task", "pos").collect() for _ in range(2))
    assert a == b and {r["family"] for r in a} == set(generate.FAMILIES)
    e = generate.keyed_episodes(spark.range(10).withColumnRenamed("id", "task"), 1, 50)
    assert e.count() == 500 and 200 < e.filter("key IS NOT NULL").count() < 450


def test_pointer():
    assert T.pointer_path("/a~1b/0/c~0d") == "$['a/b'][0]['c~d']"


def tables(spark, folder, **named):
    for name, (rows, schema) in named.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_excerpt_is_sought_in_every_document(spark, tmp_path):
    items = [(i, f"item number {i} says something of {i * i} words at least, beyond forty characters") for i in range(60)]
    docs = [(i, f"é {items[i][1]} {items[59 - i][1]}" if i % 3 else "nothing") for i in range(60)] + [(60, None), (61, items[55][1][:50])]
    d = tables(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    want = sorted((n, i, t.find(x)) for n, t in docs if t for i, x in items if x in t)
    assert sorted(map(tuple, PR.locate_excerpt(spark, d).collect())) == want
    assert {i for _, i, _ in want} == set(range(60)) - {i for i in range(60) if i % 3 == 0 and (59 - i) % 3 == 0}


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_excerpts_of_any_length_and_number(spark, monkeypatch, piece):
    monkeypatch.setattr(excerpts, "PIECE", piece)
    rng = random.Random(piece)
    docs = [(i, "".join(rng.choice("abé😀 ") for _ in range(rng.choice([0, 3, 14, 15, 400])))) for i in range(40)] + [(41, None), (None, "ab" * 50), (7, "aaaaaaaaaa" * 30), (7, "again abab")]
    texts = [t for _, t in docs if t]
    items = []
    for k in range(120):
        t = rng.choice(texts)
        at, n = rng.randrange(len(t)), rng.choice([1, 2, 7, 14, 15, 16, 40, 200])
        items.append((k, t[at : at + n] + rng.choice(["", "", "x"])))
    items += [(200, None), (201, ""), (202, "a" * 300), (203, items[0][1]), (204, "a" * 15)]
    want = {}
    for i, t in docs:
        for k, x in items:
            if t and x and x in t:
                want[i, k] = min(t.find(x), want.get((i, k), 1 << 30))
    found = excerpts.locate(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, excerpt string"))
    assert {(r["id"], r["item"]): r["place"] for r in found.collect()} == want


def test_no_excerpts(spark):
    docs, items = spark.createDataFrame([(1, "text")], "id long, text string"), spark.createDataFrame([(1, "x")], "item long, excerpt string")
    assert excerpts.locate(docs, items.limit(0)).count() == 0 and excerpts.locate(docs.limit(0), items).count() == 0


def test_credentials_are_found_and_redacted(spark, tmp_path):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----"
    secrets = ["sk-" + "a" * 24, "ghp_" + "b" * 30, "github_pat_" + "c" * 30, key, "AKIA" + "D" * 16]
    docs = [*enumerate(f"x {s} y" for s in secrets), (5, "nothing"), (6, key[:40])]
    d = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["finding"]) for r in PR.secret_scan(spark, d).collect()} == {(0, "secret key"), (1, "GitHub token"), (2, "GitHub fine-grained token"), (3, "private key"), (4, "access key"), (6, "private key")}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r["doc_id"]: r["redacted_sha256"] for r in PR.redact(spark, d).collect()} == {**{i: sha("x [REDACTED] y") for i in range(5)}, 6: sha("[REDACTED]")}


def test_every_document_is_gated(spark, tmp_path):
    ids = [i for i in range(40) if i not in (11, 23)]
    d = tables(spark, tmp_path, documents=([(i, f"t{i}") for i in ids], "doc_id long, text string"))
    want = {i: sum(i + k not in ids for k in (0, 1, 7)) for i in ids}
    got = PR.evidence_gate(spark, d).collect()
    assert {r["claim"]: r["missing"] for r in got} == want and all(r["open"] == (r["missing"] == 0) and r["n_refs"] == 3 for r in got)

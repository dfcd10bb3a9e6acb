"""The classifier: its algebra against plain forms, held-out accuracy, awkward rows."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import quality_classifier as Q
from tallybrook.llm import queries

from .. import twins

LABELS = "doc_id long, quality int, toxic int"
WORDS = [f"w{i}" for i in range(500)]


def text(rng, good):
    words = rng.choices(WORDS, k=rng.randint(30, 200))
    return " ".join(words) if good else " ".join(w + rng.choice("#$%&") for w in words)


def tables(spark, n=600, seed=0):
    rng = random.Random(seed)
    marks = [rng.random() < 0.7 for _ in range(n)]
    docs = [(i, text(rng, good), "en", 1, 0.5) for i, good in enumerate(marks)]
    schema = "doc_id long, text string, lang string, quality int, score double"
    return spark.createDataFrame(docs, schema), spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(marks)], LABELS), marks


def test_held_out_rows_are_told_apart(spark):
    docs, labels, marks = tables(spark)
    got = Q.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(marks)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) == marks[r["doc_id"]]


def test_held_out_labels_are_never_learnt(spark):
    docs, labels, _ = tables(spark, 200)
    turned = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in Q.classify(docs.repartition(p), x).collect()} for p, x in ((3, labels), (7, turned)))
    assert a == pytest.approx(b, abs=1e-12)


def test_normal_equations_and_ridge(spark):
    rng = np.random.default_rng(0)
    stats = rng.normal(size=(500, len(Q.STATISTICS))).astype(np.float32)
    y = rng.integers(0, 2, 500).astype(float)
    cosines = Q.Cosines(np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS)), 30)
    z = cosines.of(pa.array(stats.tolist(), pa.list_(pa.float32())))
    rows = spark.createDataFrame([(s.tolist(), float(t)) for s, t in zip(stats, y, strict=True)], "stats array<float>, target double")
    a, b = Q.normal_equations(rows.repartition(5), cosines, 31)
    assert np.array_equal(a, z.T @ z) and np.array_equal(b, z.T @ y)  # to the last bit
    w = Q.ridge(a, b, 0.01)
    shrink = np.diag([0.01 * 500 + 1e-3] * 30 + [0.0])
    assert np.allclose(z.T @ (z @ w - y) + shrink @ w, 0, atol=1e-8)


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(1)
    stats = rng.normal(size=(40, len(Q.STATISTICS)))
    z = Q.Cosines(np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS)), 20_000).of(pa.array(stats.tolist()))[:, :-1]
    near = z @ z.T * 2 / z.shape[1]
    far = ((stats[:, None] - stats[None]) ** 2).sum(-1)
    assert np.abs(near - np.exp(-far / (2 * Q.WIDTH**2))).max() < 0.05


def test_pools_are_the_best_rising_fit():
    rng = random.Random(0)
    for _ in range(50):
        n = rng.randint(1, 12)
        weight, mean = [rng.randint(1, 5) for _ in range(n)], [rng.random() for _ in range(n)]
        x, value = Q.isotonic(range(n), weight, mean)
        assert all(np.diff(value) > 0) and all(np.diff(x) > 0)
        # min-max form of isotonic regression
        block = lambda i, j: sum(w * m for w, m in zip(weight[i:j], mean[i:j], strict=True)) / sum(weight[i:j])
        best = [max(min(block(i, j) for j in range(k + 1, n + 1)) for i in range(k + 1)) for k in range(n)]
        assert sorted(set(np.round(best, 9))) == pytest.approx(sorted(set(np.round(value, 9))))


def test_statistics_of_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [b"", b" \n", b"a", b"a a a\na a a\n", "É é".encode(), *(" ".join(rng.choice(["aa", "BB", "c|", "Dd", "\n", "7"]) for _ in range(300)).encode() for _ in range(9))]
    whole = list(map(Q.statistics, texts))
    assert all(len(s) == len(Q.STATISTICS) and np.isfinite(s).all() for s in whole) and not any(whole[0])
    monkeypatch.setattr(Q, "PIECE", 40)
    assert np.allclose(list(map(Q.statistics, texts)), whole)


def test_awkward_rows(spark):
    docs, labels, _ = tables(spark, 120)
    odd = [(1000, None, None, None, None), (1001, "", "x", 0, 0.0), (None, "no id", "en", 1, 1.0), (1002, "long " * 1_500_000, "en", 1, 1.0)] + [(1003, "same", "en", 1, 1.0)] * 60
    more = labels.union(spark.createDataFrame([(None, 1, 0), (1003, None, 1), (1001, 1, 0), (1001, 0, 0), (5, 1, 1), (5, 7, 0)], LABELS))
    rows = Q.classify(docs.union(spark.createDataFrame(odd, docs.schema)), more).collect()
    assert len(rows) == 120 + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1000, 1001)}) == 1 and len({r["score"] for r in rows if r["doc_id"] == 1003}) == 1
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]


def test_no_labels_and_no_rows(spark):
    docs, labels, _ = tables(spark, 20)
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in Q.classify(docs, none).collect()} == {(0.5, 1)}
    assert Q.classify(docs.limit(0), labels).collect() == []
    all_good = Q.classify(docs, labels.withColumn("quality", F.lit(1))).collect()
    assert all(r["predicted"] == 1 for r in all_good)


def test_the_table(spark):
    data = os.path.join(os.path.dirname(twins.DATA), "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no tables")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(r["score"], r["predicted"], marks[r["doc_id"]]) for r in queries.op13_quality_classifier(spark, data).collect() if r["held_out"] and r["doc_id"] in marks]
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([p == q for _, p, q in held]) > 0.95
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95

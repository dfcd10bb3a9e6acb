"""Whitening against NumPy over all distinct vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import queries, whitening

from .. import twins

SCHEMA = "vec_id long, embedding array<double>, n long, z int, y string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "y") for i, v in rows], SCHEMA)


def whole(rows):
    """vec_id and x of the rows that take part, zero-padded."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in ok), default=0)
    return [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v))) for i, v in ok]


def check(got, rows, components=16):
    xs = whole(rows)
    distinct = np.array(sorted({tuple(x) for _, x in xs}), dtype=object)
    n, sums = len(distinct), distinct.sum(0)
    centred = ((distinct * n - sums) / n).astype(float)
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1][:components]
    assert len(got) == len(xs) * len(values)
    by = {}
    for r in got:
        assert r["n"] == n and r["explained"] == pytest.approx(max(values[r["component"] - 1], 0) / np.trace(v), rel=1e-4, abs=1e-12)
        assert r["identity_error"] <= 1e-4
        by.setdefault(r["vec_id"], []).append(r)
    for i, x in xs:
        own = (np.array(x, dtype=object) * n - sums)
        exact = sum(int(c) ** 2 for c in own)
        assert {r["deviation"] for r in by[i]} == {exact if exact < 2**63 else None}
    return v, values, by, xs, sums / n


def test_components_and_projections(spark):
    rng = np.random.default_rng(0)
    spread = rng.normal(size=(20, 20)) * np.linspace(1, 5, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 20)) @ spread)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows are one vector
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("-inf")] * 20), (2004, [1.0]), (2005, []), (2**62 + 1, rows[5][1])]
    got = whitening.whiten(table(spark, rows)).collect()
    v, values, by, xs, mean = check(got, rows)
    for k in range(16):
        # the axis, from the projections of all distinct vectors
        distinct = {tuple(x): next(r["whitened"] for r in by[i] if r["component"] == k + 1) for i, x in xs}
        x, z = np.array(list(distinct)).astype(float) - mean.astype(float), np.array(list(distinct.values()))
        axis = np.linalg.lstsq(x, z * np.sqrt(values[k]), rcond=None)[0]
        assert np.linalg.norm(axis) == pytest.approx(1) and np.abs(v @ axis - values[k] * axis).max() < 1e-8 * values[0]
    assert 2**62 + 1 in by


def test_null_ids_and_ids_beyond_doubles(spark):
    rows = [(2**60 + 1, [1.0, 2.0]), (None, [3.0, 5.0]), (7, [0.0, 9.0]), (7, [0.0, 9.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i, _ in rows for c in (1, 2))


def test_dimensions_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    got = whitening.whiten(table(spark, rows)).collect()
    check(got, rows)
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(None, 0.0, 0, 0.0)] * 6


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None), (2, [])], [(1, [float("nan")])]):
        assert whitening.whiten(table(spark, rows)).collect() == []


def test_huge_entries_and_long_vectors(spark):
    rows = [(0, [3e15, 1.0]), (1, [-2e15, 4.0]), (2, [1e14, -8.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    xs = [x for _, x in whole(rows)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(x, map(sum, zip(*xs, strict=True)), strict=True)) for x in xs]
    assert [{r["deviation"] for r in got if r["vec_id"] == i} for i in range(3)] == [{w if w < 2**63 else None} for w in want]
    rng = np.random.default_rng(1)
    wide = [(i, rng.normal(size=500).tolist()) for i in range(40)]
    check(whitening.whiten(table(spark, wide)).collect(), wide)
    beyond = whitening.whiten(table(spark, [(1, [1e300]), (2, [-1e300])])).collect()
    assert sorted(round(r["whitened"], 9) for r in beyond) == [-1, 1] and {r["deviation"] for r in beyond} == {None}


def test_exact_deviations_beyond_longs():
    y = np.array([[2**40, -(2**40)], [5, 6]])
    d, exact = whitening.deviations(y, 2**20, [3, -4])
    assert exact == [None, (5 * 2**20 - 3) ** 2 + (6 * 2**20 + 4) ** 2] and d[1, 0] == (5 * 2**20 - 3) / 2**20


def test_the_table(spark):
    import os

    if not os.path.isdir(twins.DATA):
        pytest.skip("no tables")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{twins.DATA}/embeddings.parquet").collect()]
    out = queries.op11_whitening(spark, twins.DATA)
    check(out.collect(), rows)
    assert out.filter(F.col("whitened").isNull()).count() == 0

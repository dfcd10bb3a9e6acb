"""The pipeline against a plain version of each stage."""

import random

import corpus_pipeline
from tallybrook.llm import common

from .test_jaccard_join import brute as brute_links
from .test_suffix_dedup import brute as brute_cut

COMMON = ["the", "of", "and", "to", "a", "in", "is", "that"]


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.25 else "".join(rng.choice("abcdefghi") for _ in range(rng.randint(3, 9))) for _ in range(n))


def table():
    rng = random.Random(8)
    shared = prose(rng, 40)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(30, 120)) + (" " + shared if i % 7 == 0 else "")
        rows.append((i, text, "en", f"s{i % 5 if i % 3 else 0}", len(text)))
    for i in range(60, 75):
        w = rows[i - 60][1].split()
        w[3] = "changed"
        rows.append((i, " ".join(w), "en", None, 1))
    rows += [(80, "$$$ %%% " * 60, "en", "s1", 480), (81, "short", "en", "s1", 5), (82, None, None, None, None), (83, "", "en", "s1", 0), (84, "same words again " * 30, "en", "s2", 510)]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, df, str(tmp_path))
    assert good.columns == df.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(kept) == {r[0] for r in rows} - {80, 81, 82, 83, 84}
    one = corpus_pipeline.near_copies(spark, good, str(tmp_path))
    assert one.columns == df.columns
    want = {d for d, _, c, _ in brute_links(sorted(kept.items())) if d == c}
    left = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(left) == want and len(want) < len(kept)
    cut = corpus_pipeline.repeated_passages(spark, one, str(tmp_path))
    assert cut.columns == df.columns
    sizes = {d: n - gone for d, n, gone, _, _ in brute_cut(sorted(left.items()))}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert {d: len(r["text"].encode()) for d, r in got.items()} == {d: n for d, n in sizes.items() if n}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    mixed = corpus_pipeline.source_mixture(spark, cut, str(tmp_path))
    assert mixed.columns == df.columns
    n_mixed = mixed.count()
    packed = corpus_pipeline.length_buckets(spark, mixed, str(tmp_path))
    assert packed.count() == n_mixed
    assert packed.filter("length > bound").count() == 0


NAMES = ["_", "row", "__n", "component_id", "length", "kept", "n", "c0", "a.b"]


def awkward(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, and names that helpers might use."""
    rng = random.Random(12)
    rows = [(d, t, s) for d, t, _, s, _ in table()]
    rows += [(None, rows[4][1], "s1"), (None, prose(rng, 80), None), (None, None, None), (3, rows[3][1], "s0"), (3, rows[3][1], "s0"), (200, prose(rng, 160_000), "s1"), (201, prose(rng, 90), None)]
    extra = lambda i: tuple(None if (i + k) % 5 == 0 else i * 10 + k for k in range(len(NAMES)))
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in NAMES)
    return spark.createDataFrame([(*r, *extra(i)) for i, r in enumerate(rows)], schema).repartition(5)


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark)
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        rows = [tuple(r) for r in out.collect()]
        if name == "packing":
            assert len(rows) == len(before) and any(r["doc_id"] is None for r in out.collect())
            continue
        assert out.columns == docs.columns and rows
        if name == "suffix-array dedup":
            assert {(r[0], *r[2:]) for r in rows} <= {(r[0], *r[2:]) for r in before}
        else:
            assert set(rows) <= set(before)
        ids = [r[0] for r in rows]
        if name == "quality rules":
            assert 200 in ids and None in ids and 82 not in ids and ids.count(3) == 3
        if name == "n-gram Jaccard join":
            assert ids.count(3) == 1 and ids.count(None) == 3 and {82, 83} <= set(ids)


def test_stages_of_an_empty_table(spark):
    docs = awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run_gives_the_last_stage(spark, tmp_path):
    spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert a and a == b
    assert common.read_table(spark, str(tmp_path), "documents").count() == 80

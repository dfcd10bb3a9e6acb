import random
import re

import numpy as np

from tallybrook.llm import jaccard_join as jj

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    def links(i):
        d, s = sets[i]
        return sum(d is not None and e is not None and i != j and bool(s) and bool(t) and 100 * len(s & t) >= 75 * len(s | t) for j, (e, t) in enumerate(sets))

    return sorted(((d, len(s), None if d is None else find(d), links(i)) for i, (d, s) in enumerate(sets)), key=repr)


def result(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    return sorted((tuple(r) for r in jj.link_documents(df, **how).collect()), key=repr)


def near_copies(rng, n):
    vocabulary = ["w%d" % i for i in range(50)]
    seeds = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i * 3, (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = near_copies(rng, 160) + [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "one"), (1005, "ONE"), (None, "one"), (1006, "one two"), (4, "w " * 3000), (5, "w " * 3001)]
    rows += [rows[0], (rows[1][0], rows[1][1])]
    assert result(spark, rows) == brute(rows)


def test_large_group_in_blocks(spark):
    rows = near_copies(random.Random(4), 120)
    assert result(spark, rows, block=8) == brute(rows)


def test_dense_block_by_products(spark):
    rng = random.Random(9)
    base = ["v%d" % rng.randrange(400) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(50)
        rows.append((i, " ".join(w)))
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, block=40) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_words_and_sets_follow_the_text():
    texts = ["Ab ab\tc", "", "  x", "a b c d e f"]
    data = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(d) for d in data])
    h, n = jj.word_hashes(np.frombuffer(b"".join(data), np.uint8), at)
    assert n.tolist() == [3, 0, 1, 6] and h[0] == h[1] != h[2] and h[4] != h[2]
    s, sizes = jj.shingle_sets(np.frombuffer(b"".join(data), np.uint8), at)
    assert sizes.tolist() == [1, 0, 1, 2] and len(s) == 4


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (3, "z", None)], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in jj.keep_one(df).collect()) == [1, 3]
    again = df.union(df.filter("doc_id <> 2")).union(spark.createDataFrame([(None, "z", "u")], df.schema))
    assert sorted(map(repr, jj.keep_one(again).collect())) == sorted(map(repr, [*df.filter("doc_id <> 2").collect(), *again.filter("doc_id IS NULL").collect()]))


def test_long_texts_null_ids_and_clashing_columns(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    near = list(words)
    near[60_000] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "x y z"), (None, "x y z"), (None, None), (4, None), (3, "x y z")]
    df = spark.createDataFrame([(d, t, 1, "g", 2) for d, t in rows], "doc_id long, text string, component_id int, chunk string, n_links int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.link_documents(df).collect()), key=repr)
    want = sorted(((d, len(shingles(t)), {1: 1, 2: 1}.get(d, d)) for d, t in rows), key=repr)
    assert got == want
    kept = jj.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None", "None"]

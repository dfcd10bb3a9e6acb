import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallybrook.llm import class_lm as lm


def corpus(n, seed=1):
    rng = random.Random(seed)
    left, right = [f"l{i}" for i in range(12)], [f"r{i}x" for i in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randint(5, 40)) for w in (rng.choice(left), rng.choice(right).upper()))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "never seen before\tÉa"), (None, "l1 r1x"), (3, rows[3][1])]


def split(rows):
    return [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2, [*(t or "").encode().lower().split(), None]) for d, t in rows]


def by_id(rows):
    return sorted(rows, key=lambda r: (repr(r[0]), r[2]))


def base_of(rows):
    docs = split(rows)
    c = Counter(w for _, out, words in docs if not out for w in words)
    n, v = sum(c.values()), len(c)
    return by_id((d, out, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, out, w in docs)


def classes_of(model):
    """word: (class, count), from the model's tables."""
    state = {r["bucket"]: lm.unpack(r["blob"]) for r in model.state.collect()}
    maps = {(r["part"], r["bucket"]): lm.unpack(r["blob"])[0] for r in model.maps.collect()}
    out = {}
    for r in model.all_parts.filter("bucket IS NOT NULL").collect():
        counts, of = state[r["bucket"]]
        for w, i in zip(lm.unpack(r["blob"])[0].split(b" "), maps[r["part"], r["bucket"]], strict=True):
            out[w] = int(of[i]), int(counts[i])
    return out


def test_base_figures_equal_brute_force(spark):
    rows = corpus(80)
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got, want = by_id(tuple(r) for r in lm.score(df).collect()), base_of(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    # words alternate between two sets, which classes see and single words don't
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


@pytest.mark.parametrize("partitions", [1, 5])
def test_scores_equal_a_brute_force_model(spark, partitions):
    rng = random.Random(5)
    rows = corpus(150) + [(1000 + i, " ".join(f"{rng.choice('ab')}{rng.randint(0, 400)}" for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    model = lm.Model(df, classes=6, seeds=8)
    of = classes_of(model)
    docs = split(rows)
    c = Counter(w for _, out, words in docs if not out for w in words)
    assert {w: n for w, (_, n) in of.items()} == {w: c[w] for _, _, words in docs for w in words if w}
    place = lambda w: 0 if w is None else of[w][0]
    assert all(1 <= place(w) < 6 for w in c if w)
    k, d = 6, lm.DISCOUNT
    tokens, distinct = np.zeros(k), np.zeros(k)
    for w, n in c.items():
        tokens[place(w)] += n
        distinct[place(w)] += 1
    assert np.array_equal(tokens, model.tokens_of) and np.array_equal(distinct, model.words_of)
    m = np.zeros((k + 1, k))
    for _, out, words in docs:
        if not out:
            for a, b in zip([None, *words[:-1]], words, strict=True):
                m[place(a), place(b)] += 1
                m[k, place(b)] += a is not None and c[a] == 1
    unknown = [0.0, *(d * distinct[i] / tokens[i] if tokens[i] else 1.0 for i in range(1, k))]
    for i in range(1, k):
        emitted = sum((n - d) / tokens[i] for w, n in c.items() if w and place(w) == i)
        assert emitted + unknown[i] == pytest.approx(1)
    spread = (m[:k].sum(0) + 1) / (m[:k].sum() + k)
    t = (m + lm.TRANSITION * spread) / (m.sum(1, keepdims=True) + lm.TRANSITION)
    assert t.sum(1) == pytest.approx(np.ones(k + 1))
    want = []
    for doc, out, words in docs:
        total, before = 0.0, 0
        for w in words:
            if w is not None and not c[w]:
                total += math.log10(sum(t[before, i] * unknown[i] for i in range(k)))
                before = k
                continue
            total += math.log10(t[before, place(w)]) + (0 if w is None else math.log10((c[w] - d) / tokens[place(w)]))
            before = place(w)
        want.append((doc, out, len(words), total))
    got = by_id((r["doc_id"], r["held_out"], r["n_tokens"], r["score"]) for r in lm.score(df, classes=6, seeds=8).collect())
    want = by_id(want)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_classes_do_not_depend_on_parts(spark, monkeypatch):
    df = spark.createDataFrame(corpus(200), "doc_id long, text string")
    few = by_id(tuple(r) for r in lm.score(df.coalesce(1)).collect())
    many = by_id(tuple(r) for r in lm.score(df.repartition(7)).collect())
    assert [r[:5] for r in few] == [r[:5] for r in many]
    assert [r[6] for r in few] == pytest.approx([r[6] for r in many])


def test_rounds_raise_the_likelihood(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"{side}{int(rng.paretovariate(0.7)) % 500}" for _ in range(40) for side in "abc")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for rounds in (0, 1, 2):
        model = lm.Model(df, classes=40, seeds=30, rounds=rounds)
        found.append(model.reached)
    assert found[0] < found[1] < found[2]


def test_rare_words_enter_by_their_contexts(spark):
    rows = corpus(300) + [(2000 + i, f"l1 rare{i} l2 r1x") for i in range(40)]
    of = classes_of(lm.Model(spark.createDataFrame(rows, "doc_id long, text string"), classes=5, seeds=12))
    right = Counter(of[f"r{i}x".encode()][0] for i in range(12))
    rare = Counter(k for w, (k, n) in of.items() if w.startswith(b"rare") and n)
    assert len(right) < 4 and not set(rare) & {of[f"l{i}".encode()][0] for i in range(12)}


def test_exchange_separates_alternating_words():
    rng = np.random.default_rng(0)
    b = np.zeros((20, 20))
    for _ in range(4000):
        b[rng.integers(10), 10 + rng.integers(10)] += 1
        b[10 + rng.integers(10), rng.integers(10)] += 1
    of = lm.exchange(b, 20, classes=2)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[10]


def test_empty_table_and_only_held_out_documents(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(99) if lm.held_out(i))
    (r,) = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"])


def test_long_and_repeated_texts_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(lm, "PIECE", 1 << 12)
    long_ = "\t".join(rng.choice(["l1", "r1x", "été", "x" * 9000]) for _ in range(30_000))
    rows = [*corpus(30), (500, long_), (500, long_), (501, "y" * 100_000)]
    df = spark.createDataFrame([(d, t, "p", 1, b"") for d, t in rows], "doc_id long, text string, part string, bucket int, blob binary")
    got, want = by_id(tuple(r) for r in lm.score(df).collect()), base_of(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


@pytest.mark.parametrize(("weighed", "table"), [(1 << 22, 1 << 24), (20, 1)])
def test_place_is_the_best_move_of_either_side(monkeypatch, weighed, table):
    rng = np.random.default_rng(3)
    n, k = 12, 5
    s = np.concatenate([[0], rng.integers(0, n, 4000) ** 2 % n])
    of = np.array([0, *rng.integers(1, k, n - 1)])
    of[s[-1]] = of[s[-1]]
    counts = np.bincount(s, minlength=n)
    m = np.zeros((k, k))
    np.add.at(m, (of[s[:-1]], of[s[1:]]), 1)
    entries = Counter()
    for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True):
        entries[a, int(of[b])] += 1
        entries[b, k + int(of[a])] += 1
    word, slot, times = (np.array(x) for x in zip(*sorted((w, c, v) for (w, c), v in entries.items()), strict=True))
    f = lambda x: x * math.log(x) if x > 0 else 0.0

    def gain(w, to):
        total = 0.0
        for side, table in ((0, m), (1, m.T)):
            left = table.copy()
            mine = {c - side * k: v for (x, c), v in entries.items() if x == w and (c >= k) == bool(side)}
            for c, v in mine.items():
                left[of[w], c] -= v
            for c, v in mine.items():
                total += f(left[to, c] + v) - f(left[to, c])
            size = left[to].sum()
            total -= f(size + sum(mine.values())) - f(size)
        return total

    monkeypatch.setattr(lm, "_WEIGHED", weighed)
    monkeypatch.setattr(lm, "_TABLE", table)
    got = lm.place(m, of, counts, word, slot, times, batch=5)
    for w in range(1, n):
        if counts[w]:
            assert gain(w, got[w]) == pytest.approx(max(gain(w, c) for c in range(1, k)))


def test_classes_grow_with_the_vocabulary(spark, monkeypatch):
    assert [lm.classes_for(n) for n in (0, 1000, 10**6, 10**9)] == [32, 32, 50, 500]
    rng = random.Random(3)
    words = [f"{k}{i}" for k in range(300) for i in range(6)]  # a word of one group is followed by one of the next
    rows = []
    for i in range(400):
        k = rng.randrange(300)
        rows.append((i, " ".join(words[6 * ((k + j) % 300) + rng.randrange(6)] for j in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (sum(r["score"] for r in lm.score(df, classes=c).collect() if r["held_out"]) for c in (32, 320))
    assert many > few + 1000  # more classes than a byte can number


def test_rounds_go_on_while_they_gain(spark, monkeypatch):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, " ".join(f"{side}{int(rng.paretovariate(0.7)) % 500}" for _ in range(40) for side in "abc")) for i in range(150)], "doc_id long, text string")
    found = []
    for gain in (10.0, 0.05, 0.0):
        monkeypatch.setattr(lm, "GAIN", gain)
        found.append(lm.Model(df, classes=40, seeds=30).reached)
    assert found[0] < found[1] <= found[2]

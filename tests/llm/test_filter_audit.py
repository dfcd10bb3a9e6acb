"""Filters under all orders against removing documents one by one."""

import itertools
import random
import re

from tallybrook.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, n int, failed string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    texts = [(i, t or "", lang or "") for i, t, lang in rows]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}

    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any(s == t and j is not None and i is not None and j < i for j, s, _ in texts),
        }

    judged = [(i, part, fails(i, t)) for i, t, part in texts]
    out = []
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        shapley, found = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                shapley[f] += len(here)
                failing = sum(d[1][f] for d in own)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                found.append((part, order, step, len(left), len(here), failing - len(here), alone, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def rows_of(rng, n):
    words = ["a", "Bb", "CC", "dd$", "é", "f|", *(f"w{i}" for i in range(300))]
    rows = []
    for i in range(n):
        few, k = rng.choice([words[:6], words[6:], words]), rng.choice([0, 5, 99, 100, 130])
        text = " ".join(rng.sample(few, k) if k <= len(few) and rng.random() < 0.7 else rng.choices(few, k=k))
        rows.append((i, text + rng.choice(["", "\n", "\x85x", "\x1cZ"]), rng.choice(["en", "de", "", None])))
    rows += [(n + i, rng.choice(rows[:20])[1], "en") for i in range(n // 2)]  # copies
    rows += [(n + 5000 + i, "the same " * 60, "en") for i in range(n // 2)]
    rows += [(None, rows[0][1], "en"), (None, rows[0][1], "en"), (0, rows[0][1], "de"), (0, rows[0][1], rows[0][2]), (1, "again", None), (9999, None, None), (9998, "", "x")]
    return rows


def test_all_orders(spark):
    rng = random.Random(0)
    rows = rows_of(rng, 60)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "p", 3, "f") for r in rows], DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == [c.split()[0] for c in filter_audit._OUT.split(", ")]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_many_parts_and_small_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, t, f"l{i % 40}") for i, (_, t, _) in enumerate(rows_of(rng, 40))]
    docs = spark.createDataFrame([(*r, "p", 3, "f") for r in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], LABELS)
    want = brute(rows, [(i, 1, 0) for i in range(50)])
    import pyarrow as pa

    judged = filter_audit.judged(docs, labels).toArrow()
    monkeypatch.setattr(filter_audit, "ROWS", 7)
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    sums = pa.Table.from_batches(list(filter_audit._count(iter(judged.to_batches(max_chunksize=16))))).to_pandas()
    tables = [filter_audit._table((p,), g.groupby("cell", as_index=False).sum(numeric_only=True)) for p, g in sums.groupby("part")]
    assert sorted(tuple(r) for t in tables for r in t.itertuples(index=False)) == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "B", "c$", "é", "\t\n", f"{i}"]) for i in range(400)).encode() for _ in range(20)] + [b"", b" ", b"x" * 999, b" x " * 99]
    whole = list(map(filter_audit.failures, texts))
    monkeypatch.setattr(filter_audit, "PIECE", 50)
    assert list(map(filter_audit.failures, texts)) == whole
    assert all(b"".join(filter_audit._pieces(t)) == t for t in texts)


def test_one_long_text(spark):
    docs = spark.createDataFrame([(1, "w x " * 3_000_000, "en")], "doc_id long, text string, lang string")
    got = filter_audit.audit(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 600 and {r["shapley"] for r in got} == {0, 120}


def test_no_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).collect() == []

import hashlib
import random

import pytest

from tallybrook.llm import suffix_dedup as sd


def brute(rows, window=100):
    """Result rows by a dictionary of every window."""
    tie = lambda t: hashlib.blake2b((t or "").encode(), digest_size=8).digest()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]) if r[0] is None else b"", r[1] is not None, r[1] or ""))
    seen, out = set(), []
    for doc, text in order:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            w = data[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(data)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_id_ string")
    return sorted((tuple(r) for r in sd.measure(df.drop("doc_id_")).collect()), key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def test_random_with_shared_passages(spark):
    rng = random.Random(5)
    passages = [words(rng, 40) for _ in range(6)] + ["is on. " * 60, "a" * 400]
    rows = []
    for i in range(150):
        parts = [words(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            s = rng.randint(0, len(p) // 2)
            parts += [p[s : s + rng.randint(50, 300)], words(rng, rng.randint(0, 30))]
        rows.append((i, " ".join(parts), ""))
    rows += [(200, rows[3][1], ""), (201, rows[3][1], ""), (202, None, ""), (203, "", ""), (None, rows[4][1], ""), (7, rows[7][1], ""), (7, rows[8][1], "")]
    assert result(spark, rows) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("many", [3])
def test_hot_anchors_are_sorted_by_windows(spark, monkeypatch, many):
    rng = random.Random(6)
    p = words(rng, 60)
    rows = [(i, words(rng, 20) + p + words(rng, 20), "") for i in range(60)]
    kernel = sd._answer

    import pyarrow as pa

    own = []
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows]), "text": [r[1] for r in rows]})
    key = (pa.scalar(0, pa.int32()),)
    monkeypatch.setattr(sd, "HOT", many)
    announced = sd._announce(4)(key, docs)
    answers = [kernel((pa.scalar(b, pa.int32()),), announced.filter(pa.compute.equal(announced["bucket"], b))) for b in sorted(set(announced["bucket"].to_pylist()))]
    told = pa.concat_tables(answers)
    assert any((sd.unpack(f)[0] == 2).any() for f in told["flags"].to_pylist())
    runs = sd._send_runs(4)(key, docs, told)
    for b in range(4):
        own.append(sd._combine((pa.scalar(b, pa.int32()),), runs.filter(pa.compute.equal(runs["bucket"], b))))
    found = pa.concat_tables(own)
    texts = sd.Texts(docs)
    got = sorted(((i, len(k) + n, n, s, hashlib.sha256(k).hexdigest()) for i, (n, s, k) in zip(texts.ids.to_pylist(), sd._cut(texts, sd._stretches(found)), strict=True)), key=repr)
    assert got == brute([r[:2] for r in rows])


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_many_rows_without_id(spark, partitions):
    rng = random.Random(8)
    p = words(rng, 60)
    rows = [(None, words(rng, rng.randint(5, 40)) + p, "") for _ in range(30)] + [(None, p, "")] * 3 + [(9, p, ""), (None, None, ""), (None, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(partitions)
    assert sorted((tuple(r) for r in sd.measure(df).collect()), key=repr) == brute([r[:2] for r in rows])


def test_long_documents_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    p = words(rng, 400)
    rows = [(i, words(rng, rng.randint(200, 900)) + p + words(rng, 300) + p[50:] + "z" * 1500, "") for i in range(4)]
    import pyarrow as pa

    monkeypatch.setattr(sd, "SEGMENT", 1 << 10)
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows]), "text": [r[1] for r in rows]})
    key, of = (pa.scalar(0, pa.int32()),), lambda t, b: t.filter(pa.compute.equal(t["bucket"], b))
    announced = sd._announce(2)(key, docs)
    told = pa.concat_tables([sd._answer((pa.scalar(b, pa.int32()),), of(announced, b)) for b in (0, 1)])
    runs = sd._send_runs(2)(key, docs, told)
    found = pa.concat_tables([sd._combine((pa.scalar(b, pa.int32()),), of(runs, b)) for b in (0, 1)])
    texts = sd.Texts(docs)
    got = [(i, len(k) + n, n, s, hashlib.sha256(k).hexdigest()) for i, (n, s, k) in zip(texts.ids.to_pylist(), sd._cut(texts, sd._stretches(found)), strict=True)]
    assert sorted(got, key=repr) == brute([r[:2] for r in rows])


def test_clashing_columns(spark):
    text = words(random.Random(1), 100)
    names = ["_", "row", "none", "c0", "chunk", "stretches", "a.b", "bucket"]
    df = spark.createDataFrame([(1, text, *range(8)), (2, text, *range(8, 16))], ["doc_id", "text", *names])
    (r,) = sd.dedup(df).collect()
    assert r.asDict() == {"doc_id": 1, "text": text} | dict(zip(names, range(8), strict=True))
    assert len(sd.measure(df).collect()) == 2


def test_empty_and_own_columns(spark):
    assert result(spark, []) == []
    text = words(random.Random(1), 100)
    df = spark.createDataFrame([(1, text, "a", 5), (2, text, None, None), (3, "x", "b", 1)], "doc_id long, text string, row string, n_chars int")
    out = {r["doc_id"]: r for r in sd.dedup(df).collect()}
    assert set(out) == {1, 3} and out[1]["row"] == "a" and out[1]["n_chars"] == len(text) and sd.dedup(df).columns == df.columns


def test_loser_tree_equals_sorting():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [sd.front_code(r) for r in runs]
    assert [sd.decode(*c) for c in coded] == runs
    order, shared = sd.merge_runs([(r, c[1].tolist()) for r, c in zip(runs, coded, strict=True)])
    merged = [runs[i][j] for i, j in order]
    assert merged == sorted(x for r in runs for x in r)
    assert shared[1:] == [sd.common_prefix(a, b) for a, b in zip(merged, merged[1:], strict=False)]

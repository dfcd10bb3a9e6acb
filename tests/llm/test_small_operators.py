"""URL rules, token counts, quality, mixing, top-k, packing and licences on small tables."""

import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import licences, mix, packing, quality, queries, token_count, topk, url_filter


# ------------------------------------------------ URL filters
@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")),
        ("example.com/en/1", ("", "", None, "allow")),
        ("http://A.Example.COM/en/7x?q#f", ("a.example.com", "/en/7x", "example.com/en/7", "allow")),
        ("https://x.com/en/8", ("x.com", "/en/8", "com/en/", "block")),
        ("https://xcom/en/8", ("xcom", "/en/8", None, "allow")),
        ("http://b.example.net/de/80", ("b.example.net", "/de/80", "example.net/de/8", "block")),
        ("http://b.example.net/de/7?xxx", ("b.example.net", "/de/7", "net/de/", "allow")),
        ("http://w.org/es/", ("w.org", "/es/", "org/es/", "block")),
        ("http://w.org?/es/", ("w.org", "", None, "allow")),
        ("http://x.org/Casino-1", ("x.org", "/Casino-1", None, "block")),
        ("http://x.org/casinobar", ("x.org", "/casinobar", None, "allow")),
        ("http://ads-track.x.org/", ("ads-track.x.org", "/", None, "block")),
        ("http://x.org/" + "a" * 20_000 + "/viagra", ("x.org", "/" + "a" * 20_000 + "/viagra", None, "block")),
        ("http://x.org/free-free", ("x.org", "/free-free", None, "allow")),
        ("http://free-bets.x.org/", ("free-bets.x.org", "/", None, "block")),
        ("http://", ("", "", None, "allow")),
    ],
)
def test_urls(spark, url, want):
    df = spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")
    assert tuple(url_filter.filter_urls(df).first())[1:5] == want


def test_repeated_urls_and_clashing_columns(spark):
    rows = [(1, "http://a.net/x", "h", 9, "v")] * 3 + [(None, "http://casino.a.net/", "h", 9, "v"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, weight int, verdict string")
    got = sorted(((r["page_id"], r["verdict"], r["weight"]) for r in url_filter.filter_urls(df).collect()), key=repr)
    assert got == [(1, "allow", 0)] * 3 + [(2, "allow", 0), (None, "block", 2)]


def test_no_urls(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# ------------------------------------------------ token counts
TEXTS = [None, "", " ", "Hello, world's best 2024!", "<|endoftext|>a<|startoftext|>", "a\x1cb\x85c　d", "ÀÉ Σίσυφος ΑΣ İ ﬁ", "x" * 3000, "don't we'll I'M", "日本語 テスト 🙂🙂", "é x", "a_b--c 1234567890 ½ ²", "​zero", "<|endoftext|", "tab\tnew\nline\r\n"]


def test_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(0)
    alphabet = "abcdefghijklmnopqrstuvwxyz ABC éüß'.,-_12<|>\n\t 中"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_count.count_tokens(df, path, limit=100).collect():
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100), text


def test_merges_prefer_rank_then_place():
    ranks = {("a", "a"): 1, ("b", "c"): 0, ("aa", "a"): 2}
    assert token_count.merge_count(list("aaa"), ranks) == 1
    assert token_count.merge_count(list("aaaa"), ranks) == 2
    assert token_count.merge_count(list("abcb"), ranks) == 3
    assert token_count.merge_count([], ranks) == 0 and token_count.merge_count(["a"], ranks) == 1


# ------------------------------------------------ quality
def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n)


def test_quality_figures(spark):
    rng = random.Random(2)
    texts = [None, "", "\n \n", "one", "a b c d e f g h i j", "a b c d e " * 4, "x\ny\nx\n\nx", "#$ é\x0b\x0cz " * 20, "w " * 4000]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    for r in quality.quality(df).collect():
        assert tuple(r)[1:7] == brute_quality(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(3)
    prose = " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.2 else "".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(300))
    junk = " ".join("".join(rng.choice("#*$%&|<>") for _ in range(5)) for _ in range(300))
    df = spark.createDataFrame([(1, prose, 1), (2, junk, 2)], "doc_id long, text string, row int")
    assert [tuple(r) for r in quality.keep_good(df).collect()] == [(1, prose, 1)]


def test_references_from_texts(spark):
    rows = [("en", "The cat of the house 12"), ("en", "the # of"), ("de", "der Fuß"), (None, "x"), ("de", None)]
    chars, common = quality.references(spark.createDataFrame(rows, "lang string, text string"), words=2)
    assert common == {"en": {"the": 333, "of": 222}, "de": {"der": 500}}
    assert chars["de"] == (0.125, 0.0, 0.0, 0.125, 0.75) and sum(chars["en"]) == pytest.approx(1, abs=1e-3)
    df = spark.createDataFrame([(1, "the cat of the dog of " * 9), (2, "zzz 1234 qqq 99 " * 14)], "doc_id long, text string")
    got = {r["doc_id"]: r["char_distance"] for r in quality.quality(df, char_reference=chars, word_reference=common).collect()}
    assert got[1] < got[2]


def test_quality_of_repeated_long_and_no_rows(spark):
    long_ = "the of and to a in is that " * 120_000
    df = spark.createDataFrame([(1, long_), (2, "one two"), (2, "one two")], "doc_id long, text string")
    got = sorted(map(tuple, quality.quality(df).select("doc_id", "n_words", "base_failed").collect()))
    assert got == [(1, 960_000, True), (2, 2, True), (2, 2, True)]
    assert quality.quality(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).columns == df.columns


def test_token_counts_of_repeated_and_no_rows(spark):
    pytest.importorskip("tokenizers")
    path = queries.vocabulary("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"]) for r in token_count.count_tokens(df, path).collect())
    assert got == [(1, 3), (1, 3), (2, 0)] and token_count.count_tokens(df.limit(0), path).count() == 0


# ------------------------------------------------ mixing
def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = dict(w)
    while open_:
        share = {s: left * open_[s] / sum(open_.values()) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice(["a", "b", "é", "z", "Z", "m1", "m2", None, "ä", "q"]): rng.choice([0, 5, 5, 100, rng.randint(1, 1000)]) for _ in range(8)}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mix.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["a", "b", None])) for i in range(900)] + [(900, None, "c"), (None, "x y", "a")]
    df = spark.createDataFrame([(i, t, s, "t") for i, t, s in rows], "doc_id long, text string, source string, target string")
    plan = mix.mix_plan(df).collect()
    assert len(plan) == len(rows) and sorted(map(str, plan)) == sorted(map(str, mix.mix_plan(df).collect()))
    for s in ("a", "b", None):
        own = [r for r in plan if r["source"] == s]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert taken == pytest.approx(own[0]["target"], rel=0.1) and all(r["copies"] <= 2 for r in own)
    assert sorted(str(r["doc_id"]) for r in mix.mix(df).select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in plan for _ in range(r["copies"]))
    assert mix.mix_plan(df.limit(0)).count() == 0 and mix.mix(df).columns == df.columns


@pytest.mark.parametrize("partitions", [1, 5])
def test_mixture_of_clashing_columns_and_long_texts(spark, partitions):
    names = ["__n", "__rate", "row", "n", "size", "rate", "of_source", "a.b"]
    rows = [(i, "w " * (i + 1), "ab"[i % 2], *range(i, i + 8)) for i in range(40)] + [(99, "long\t" * 700_000 + "x" * 2_100_000, "c", *range(8))]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names]).repartition(partitions)
    plan = {r["doc_id"]: r for r in mix.mix_plan(df).collect()}
    assert plan[99]["size"] == 700_001
    got = mix.mix(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows for _ in range(plan[r[0]]["copies"]))


def test_many_sources_are_numbered_in_order(spark):
    names = [None, *(f"s{i:03d}" for i in range(150))]
    df = spark.createDataFrame([(s, 1) for s in reversed(names)], "source string, size long").repartition(9)
    got = {r["source"]: r["place"] for r in mix._numbered(df).collect()}
    assert got == {s: i for i, s in enumerate([*names[1:], None])}


# ------------------------------------------------ top-k
def brute_topk(rows, k=5, every=50):
    ok = [(i, [int(np.floor(np.float64(c) * 256)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(100)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (None, rows[0][1]), (2050, []), (2051, [1.0])]
    monkeypatch.setattr(topk, "CANDIDATES", 10)  # some 50 blocks
    monkeypatch.setattr(topk, "PIVOTS", 7)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert sorted(map(tuple, topk.exact_topk(df).collect())) == brute_topk(rows)
    assert topk.exact_topk(df.limit(0)).count() == 0
    monkeypatch.setattr(topk, "PIVOTS", 3)
    scaled = [(i, [c * (1 + i % 7) for c in v]) for i, v in rows[:500]] + [(100, rows[7][1]), (500, rows[8][1])]  # norms differ, ids repeat
    got = topk.exact_topk(spark.createDataFrame(scaled, "vec_id long, embedding array<float>")).collect()
    want = {}
    for q, v in scaled:
        if q % 50 == 0:
            for i, w in scaled:
                if i != q:
                    want.setdefault(q, []).append((-int(np.floor(np.float64(np.float32(v)) * 256) @ np.floor(np.float64(np.float32(w)) * 256)), i))
    assert sorted(map(tuple, got)) == sorted((q, n + 1, i, -s) for q, found in want.items() for n, (s, i) in enumerate(sorted(found)[:5]))


def test_groups_far_from_a_query_are_not_visited(spark, monkeypatch):
    """Unit vectors around some directions: bounds hold for all vectors, and rule most groups out."""
    rng = np.random.default_rng(1)
    centres = np.eye(12) * 256
    x = np.floor(centres[rng.integers(0, 12, 1500)].T + rng.normal(size=(12, 1500)) * 8)
    unit, norm = topk._unit(x)
    pivots = unit.T[:40]
    angles = topk._angles(unit, pivots)
    group = angles.argmin(0)
    widest = np.array([*(angles[g, group == g].max(initial=0) for g in range(40)), 0.0])
    most = np.array([*(norm[group == g].max(initial=-1) for g in range(40)), 0.0])
    ceiling = topk.reach(unit[:, :30], norm[:30], pivots, widest, most)
    scores = x[:, :30].T @ x
    assert all(ceiling[group[j], i] >= scores[i, j] for i in range(30) for j in range(1500))
    fifth = np.sort(scores, 1)[:, -6]
    assert (ceiling >= fifth).mean() < 0.4
    rows = [(i, (x[:, i] / 256).tolist()) for i in range(1500)] + [(3000, [0.0] * 12), (3001, [0.0] * 12)]
    monkeypatch.setattr(topk, "CANDIDATES", 30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.exact_topk(df).collect())) == brute_topk(rows)


def test_topk_of_few_and_huge(spark):
    rows = [(0, [3e30]), (1, [1e30]), (2, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in topk.exact_topk(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]


# ------------------------------------------------ packing
def test_bounds_are_optimal():
    rng = random.Random(0)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 50) for _ in lengths]
        k = rng.randint(1, 5)
        got = packing.padding(lengths, counts, packing.optimal_bounds(lengths, counts, k))
        best = min(packing.padding(lengths, counts, sorted({*c, lengths[-1]})) for c in itertools.combinations(lengths, min(k, len(lengths)) - 1))
        assert got == best
    assert packing.optimal_bounds([], []) == []


def test_bounds_of_many_lengths():
    rng = np.random.default_rng(3)
    lengths, counts = np.arange(1, 3001), rng.integers(1, 1000, 3000)
    bounds = packing.optimal_bounds(lengths, counts, 8)
    least = packing.padding(lengths, counts, bounds)
    assert len(bounds) == 8 and bounds[-1] == 3000
    for i in range(7):
        for step in (-1, 1):
            moved = sorted({*bounds[:i], bounds[i] + step, *bounds[i + 1 :]})
            assert packing.padding(lengths, counts, moved) >= least


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 50)) for i in range(500)] + [(500, None), (501, "w " * 3000), (3, "again")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int")
    out = packing.pack(df, buckets=4, budget=400).collect()
    assert len(out) == len(rows)
    batches = {}
    for r in out:
        assert r["length"] <= r["bound"] and r["padding"] == r["bound"] - r["length"]
        batches.setdefault(r["batch"], []).append(r)
    for b in batches.values():
        assert len({r["bound"] for r in b}) == 1 and sorted(r["position"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["bound"] <= 400
    assert packing.pack(df.limit(0)).count() == 0


# ------------------------------------------------ licences
@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts")
def test_whole_published_licences(spark):
    folder, names = "/usr/share/common-licenses", dict(licences.DIGESTS)
    texts = {}
    for f in os.listdir(folder):
        if not os.path.islink(f"{folder}/{f}"):
            with open(f"{folder}/{f}", encoding="utf8") as text:
                texts[f] = text.read()
    rows = [(f, t) for f, t in texts.items()] + [(f"{f} again", "(c) 1999 Someone\n\n" + t.upper().replace("\n", " \r\n  # ")) for f, t in texts.items()] + [(f"{f} cut", t[:-40]) for f, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(df).collect()}
    assert all(got[f] in names and got[f"{f} cut"] is None for f in texts) and len({got[f] for f in texts}) == len(texts)
    assert got["Apache-2.0"] == "Apache-2.0" and got["GPL-3"] == "GPL-3.0" and got["MPL-2.0"] == "MPL-2.0"
    assert all(got[f"{f} again"] == got[f] for f in texts)


def test_long_and_repeated_texts_match_nothing_else(spark):
    mit = dict(licences.LICENCES[:1])["MIT"]
    df = spark.createDataFrame([(1, mit + " x" * 2_000_000, 1), (2, mit, 2), (2, mit, 3)], "doc_id long, text string, digest int")
    assert sorted((r["doc_id"], r["licence"]) for r in licences.scan(df).select("doc_id", F.coalesce("licence", F.lit("-")).alias("licence")).collect()) == [(1, "-"), (2, "MIT"), (2, "MIT")]


def test_licences(spark):
    mit = dict(licences.LICENCES[:1])["MIT"]
    texts = [mit, "Copyright (c) 2024 Jane\n\n" + mit.upper().replace(",", " ;"), "MIT text: " + mit, None, "", "...", "Released under the MIT Licence", mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licence string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(df).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: None, 6: "MIT", 7: "MIT"}
    assert licences.scan(df.limit(0)).count() == 0


# ------------------------------------------------ awkward rows
def test_token_counts_of_long_texts_and_clashing_columns(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    long_ = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(200_000))
    df = spark.createDataFrame([(1, long_, 5, True, "x"), (2, None, 6, None, None), (None, "a b", 7, False, "y")], "doc_id long, text string, n_tokens int, over_limit boolean, n_bytes string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(df, path).collect()}
    n = len(library.encode(long_, add_special_tokens=False).ids)
    assert got == {1: (len(long_.encode()), n, True), 2: (0, 0, False), None: (3, 2, False)}


def test_packing_of_long_texts_ties_and_clashing_columns(spark):
    rows = [(1, "w " * 400_000), (2, "w"), (2, "w"), (None, "w"), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, 7, "b", 0) for i, t in rows], "doc_id long, text string, length int, bucket string, batch int")
    out = packing.pack(df, buckets=2, budget=10).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in out) == [("1", 400_001), ("2", 2), ("2", 2), ("3", 1), ("None", 1), ("None", 2)]
    assert all(r["length"] <= r["bound"] and r["padding"] == r["bound"] - r["length"] for r in out)
    spots = [(r["batch"], r["position"]) for r in out]
    assert len(set(spots)) == len(spots)

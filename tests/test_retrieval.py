import itertools
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.functions import text as T
from tallybrook.operators import evaluation as E
from tallybrook.operators import packing as P
from tallybrook.operators import retrieval as R

TURNS = [
    (1, 0, 0, "user", "I live in Seattle. It rains."), (1, 0, 1, "assistant", "Noted: Austin!"),
    (1, 1, 0, "user", "Recently I moved to Austin.\n\nThe café is new."), (1, 1, 1, "system", "x"), (1, 2, 0, "user", "Tell me about jazz"),
]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(TURNS, "uid long, session long, turn long, role string, text string")


@pytest.fixture
def query(spark):
    return spark.createDataFrame([(1, "q", "where do I live, Austin or Seattle?")], "uid long, dim string, query string")


def test_documents(turns):
    d = R.documents(turns, "sentence").orderBy("doc_i").collect()
    assert [x["text"] for x in d] == ["I live in Seattle.", "It rains.", "Recently I moved to Austin.", "The café is new.", "Tell me about jazz"]
    assert [x["rank"] for x in d] == [0, 0, 1, 1, 2] and [x["cue"] for x in d] == [0, 0, 1, 1, 0]
    assert d[1]["serialized"] == "[session 0, turn 0, sentence 1] It rains.\n" and d[3]["bytes"] == len(d[3]["serialized"].encode())


def test_bm25_by_hand(turns, query):
    got = {r["doc_i"]: r["score"] for r in R.scores(R.documents(turns), query).collect()}
    lengths, n = [4, 5, 3], 3
    docs = [{"live": 1, "seattle": 1, "rains": 1}, {"recently": 1, "moved": 1, "austin": 1, "caf": 1, "new": 1}, {"tell": 1, "about": 1, "jazz": 1}]
    lengths = [sum(d.values()) for d in docs]
    avg = sum(lengths) / n
    want = [sum(math.log(1 + (n - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[i] / avg)) for t in ("live", "austin", "seattle") if t in d) for i, d in enumerate(docs)]
    assert got == pytest.approx(dict(enumerate(want)), abs=1e-8)


def test_ties_go_to_the_later_document(turns, spark):
    q = spark.createDataFrame([(1, "q", "nothing matches")], "uid long, dim string, query string")
    assert [r["doc_i"] for r in R.ranked(R.scores(R.documents(turns), q), "bm25").orderBy("rn").collect()] == [2, 1, 0]


WORDS = "harbor lantern meadow orchard pebble thicket".split()


def same_weights():
    """Texts of the same words, in which the same counts go to other words: scores are sums of the same weights."""
    return [" ".join(" ".join([w] * k) for w, k in zip(WORDS, counts, strict=True)) for counts in itertools.islice(itertools.permutations((1, 2, 4, 7, 11, 16)), 0, None, 9)]


def test_sums_of_the_same_weights_tie(spark):
    rows = [(1, i, 0, "user", t) for i, t in enumerate(same_weights())]
    docs = R.documents(spark.createDataFrame(rows, "uid long, session long, turn long, role string, text string"))
    scored = R.scores(docs, spark.createDataFrame([(1, "q", " ".join(WORDS))], "uid long, dim string, query string"))
    assert scored.select("score").distinct().count() == 1
    assert [r["doc_i"] for r in R.ranked(scored, "rrf").orderBy("rn").collect()] == [*range(len(rows))][::-1]


def test_sums_of_the_same_weights_tie_in_sentences(spark):
    text = " ".join(f"{t}." for t in same_weights())
    docs = R.documents(spark.createDataFrame([(1, 0, 0, "user", text)], "uid long, session long, turn long, role string, text string"), "sentence")
    scored = R.scores(docs, spark.createDataFrame([(1, "q", " ".join(WORDS))], "uid long, dim string, query string"))
    got = [r["doc_i"] for r in R.ranked(scored, "rrf").orderBy("rn").collect()]
    assert got == [*range(len(same_weights()))][::-1]


def test_exact_sums_are_rounded_once(spark):
    rng = np.random.default_rng(7)
    groups = [rng.uniform(0, 10, n) * 10.0 ** -rng.integers(0, 6, n) for n in rng.integers(1, 40, 300)]
    rows = [(i, float(x)) for i, g in enumerate(groups) for x in g]
    got = spark.createDataFrame(rows, "i int, x double").repartition(5, "x").groupBy("i").agg(R.exact_sum(F.col("x")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: math.fsum(g) for i, g in enumerate(groups)}


@pytest.mark.parametrize(("n", "df"), [(15, {"alpha": 1, "beta": 7, "gamma": 2, "delta": 4}), (13, {"alpha": 1, "beta": 7, "gamma": 2, "delta": 4})])
def test_scores_of_two_words_are_sums_of_doubles(spark, n, df):
    """1.5 * 7.5 = 2.5 * 4.5, so the two sentences of two words differ in the last digit of a sum, or not at all."""
    single = [w for w, k in df.items() for _ in range(k - 1)]
    parts = [*single, *["the"] * (n - 2 - len(single)), "gamma delta", "alpha beta"]
    docs = R.documents(spark.createDataFrame([(1, 0, 0, "user", " ".join(f"{p}." for p in parts))], "uid long, session long, turn long, role string, text string"), "sentence")
    got = R.scores(docs, spark.createDataFrame([(1, "q", " ".join(df))], "uid long, dim string, query string"))
    avg = sum(df.values()) / n

    def weight(word, length):
        return math.log(1 + (n - df[word] + 0.5) / (df[word] + 0.5)) * 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / max(1.0, avg)))

    want = {i: sum(weight(w, len(p.split())) for w in p.split() if w != "the") for i, p in enumerate(parts)}
    assert {r["doc_i"]: r["score"] for r in got.collect()} == want


@pytest.mark.parametrize("strategy", R.STRATEGIES)
def test_packs_fit(turns, query, strategy):
    ranked = R.ranked(R.scores(R.documents(turns), query), strategy)
    packed = (P.pack_stop if strategy == "stop" else P.pack_greedy)(ranked, (1, 50, 100, 4096)).collect()
    assert {r["budget"] for r in packed} == {1, 50, 100, 4096}
    for r in packed:
        assert r["bytes"] == len(r["context"].encode()) <= r["budget"] and "Noted" not in r["context"] and r["selected"] == sorted(r["selected"])
    assert len(next(r for r in packed if r["budget"] == 4096)["selected"]) == 3


def test_greedy_goes_on_where_stop_ends(turns, query):
    ranked = R.ranked(R.scores(R.documents(turns), query), "bm25")
    budget = 45
    greedy, stop = P.pack_greedy(ranked, (budget,)).first(), P.pack_stop(ranked, (budget,)).first()
    assert set(stop["selected"]) <= set(greedy["selected"])


def test_inclusion(spark):
    f = lambda a, b: spark.range(1).select(T.includes_tokens(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert f("I reside in AUSTIN!", "Austin.") and not f("I reside in Austin", "side") and not f("x", "...")


def test_policy_faults(spark):
    ok, nan = ("fine-1", 0.5, 0.0, 0.0), float("nan")
    bad = [("p", w, 0.0, 0.0) for w in (nan, float("inf"), -1.0, 2.0, None)] + [("p", 0.0, 0.0, 0.0), ("Upper", 1.0, 0.0, 0.0), (None, 1.0, 0.0, 0.0), ("x" * 41, 1.0, 0.0, 0.0), ("a\n", 1.0, 0.0, 0.0)]
    got = R.policy_faults(spark.createDataFrame([ok, *bad], R.POLICY_SCHEMA)).collect()
    assert [r["faults"] for r in got if r["name"] == "fine-1"] == [[]]
    assert all(r["faults"] for r in got if r["name"] != "fine-1")
    with pytest.raises(ValueError, match="no weight"):
        R.ranked_by_policy(spark.range(0), spark.createDataFrame([("p", 0.0, 0.0, 0.0)], R.POLICY_SCHEMA))


def test_slices_leave_the_draws_as_they_are():
    x = np.random.default_rng(1).random((37, 2))
    for cells in (1, 40, 5000):
        got = E.resampled_means(x, 5, 300, cells)
        picks = np.random.default_rng(5).integers(0, 37, (300, 37))
        assert np.array_equal(got, np.stack([x[:, c][picks].mean(1) for c in range(2)]))


def brute_weight(uid, b, seed):
    import hashlib

    p = E.PRIME
    x, k = int(hashlib.md5(str(uid).encode()).hexdigest()[:8], 16) % p, ((b + 1) * 48271 + seed) % p
    for _ in range(3):
        x, k = pow((x + k) % p, 5, p), (k * 69621 + 1) % p
    return sum(x >= r for r in E.RISES)


def test_weighted_intervals_are_those_of_poisson_resamples(spark):
    rows = [(g, u, float((u * 7 + len(g)) % 11), float(u)) for g, n in (("a", 1), ("bb", 6), ("ccc", 9)) for u in range(n)] + [("bb", 99, None, 1.0), ("d", 1, None, 0.0)]
    df = spark.createDataFrame(rows, "g string, uid long, x double, y double").repartition(5)
    got = {(r["g"], r["metric"]): r for r in E.weighted_intervals(df, ["g"], ["x", "y"], repeats=101, seed=7).collect()}
    for g in ("a", "bb", "ccc"):
        for i, metric in ((2, "x"), (3, "y")):
            own = [r for r in rows if r[0] == g and r[2] is not None]
            means = []
            for b in range(101):
                w = [brute_weight(r[1], b, 7) for r in own]
                if sum(w):
                    means.append(sum(k * r[i] for k, r in zip(w, own, strict=True)) / sum(w))
            r = got[g, metric]
            assert r["n"] == len(own) and r["mean"] == pytest.approx(np.mean([v[i] for v in own]))
            assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(means, (0.025, 0.975))))
    assert (got["d", "x"]["n"], got["d", "x"]["low"]) == (0, None)


def test_weights_are_poisson_and_independent(spark):
    rows = E.resample_weights(spark.range(200).select(F.col("id").alias("uid")), 1000, 3).toPandas()
    w = rows.pivot(index="uid", columns="b", values="w").to_numpy().astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    off = np.corrcoef(w)[np.triu_indices(200, 1)]
    assert abs(off.mean()) < 0.002 and off.std() < 0.04  # as for independent ones: 1 / sqrt(1000)
    off = np.corrcoef(w.T)[np.triu_indices(1000, 1)]
    assert abs(off.mean()) < 0.002 and off.std() < 0.08


def test_weighted_intervals_cover_as_the_generators_do(spark):
    x = np.random.default_rng(2).normal(size=300)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, uid long, x double")
    r = E.weighted_intervals(df, ["g"], ["x"], repeats=4000).first()
    _, _, low, high = E.interval(x)
    assert abs(r["low"] - low) < 0.02 and abs(r["high"] - high) < 0.02
    o = E.weighted_order(df, ["g"], "x").first()
    assert abs(o["low"] - low) < 0.03 and abs(o["high"] - high) < 0.03


def test_strata_keep_an_empty_side(spark):
    rows = spark.createDataFrame([(m, 4096, u, float(m == "sentence_bm25")) for m in ("turn_bm25", "sentence_bm25") for u in (1, 2, 3)], "method string, budget int, uid long, new double")
    audit = spark.createDataFrame([(u, 5, 1.0 * u, 0.0) for u in (1, 2, 3)], "uid long, history_bytes long, median_turn_bytes double, update_fraction double")
    got = {(r["field"], r["side"]): (r["n"], r["mean"]) for r in E.strata(rows, audit).collect()}
    assert len(got) == 6 and got["history_bytes", "high"] == (0, None) and got["median_turn_bytes", "low"] == (2, 1.0)


def test_two_level_mean_differs_from_the_plain_one(spark):
    rows = spark.createDataFrame([("m", 1, 1, 1), ("m", 1, 1, 1), ("m", 1, 1, 1), ("m", 1, 2, 0)], "method string, budget int, uid long, new int")
    assert E.two_level(rows, metrics=("new",)).first()["new"] == 0.5


def test_bounds_without_grades(spark):
    rows = spark.createDataFrame([("m", u, arm, True, False, None) for u in (1, 2) for arm in ("sentence_bm25", "turn_bm25")], "model string, uid long, arm string, answered boolean, graded boolean, pass boolean")
    r = E.missing_bounds(rows, (("sentence_bm25", "turn_bm25"),)).first()
    assert (r["low"], r["high"], r["n"], r["mean"]) == (-1, 1, 0, None)
    s = E.reader_summary(rows).first()
    assert (s["attempted"], s["graded"], s["missing_as_failure"], s["mean"]) == (2, 0, 0, None)


def test_intervals():
    assert E.interval([]) == (0, None, None, None)
    n, mean, low, high = E.interval([0, 1, 1, 0, 1])
    assert n == 5 and mean == 0.6 and low <= mean <= high and E.interval([0, 1, 1, 0, 1]) == (n, mean, low, high)
    assert E.order_interval([2.0, 2.0]) == (2.0, 2.0)


TEXTS = ["one\r\n\ttwo", "a.  b!\x0bc\x1f\xa0. d", "x\xa0\xa0y \ufb01\uff21", "Stra\u00dfe \u0130I", "\u2003lead\u3000tail \n\n", "", " ", None, "e\u0301 \u00c9 \u00b5 \u2026 \u201cq\u201d", "A\x1cB\x85C"]


def test_sentences_as_python_splits_them(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r["x"] for r in df.select(T.sentences(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", t) if p.strip()] for t in TEXTS]


def test_normalize_folds_all_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r["x"] for r in df.select(T.normalize(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in TEXTS]
    assert df.select(T.includes(F.lit("see X\xa0Y \ufb01n"), F.lit("x y FIN")).alias("x")).first()["x"]


def test_normalize_any(spark):
    df = spark.createDataFrame([("  ＡＢ Straße ",)], "t string")
    assert df.select(T.normalize_any("t").alias("x")).first()["x"] == "ab strasse"


def test_all_items_are_dealt(spark, tmp_path):
    from tallybrook.sources import tables as S

    spark.createDataFrame([(10 * u, 0, "user", f"t{u}") for u in range(60)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"q{i}") for i in range(50)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    asked = S.queries(spark, str(tmp_path)).filter("dim = 'benchmark'").collect()
    assert sorted((r["uid"], r["query"]) for r in asked) == [(u, f"q{u % 50}") for u in range(60)]

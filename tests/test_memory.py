import random

import pytest

from tallybrook.operators import memory as M

SCHEMA = "task long, pos long, op string, key string, source string, version int, value string"
A, B = ("P", "k", "a", 1, "A"), ("P", "k", "b", 1, "A")
CASES = [
    ([A, B], "A"),
    ([A, B, ("P", "k", "a", 2, "B")], "CONFLICT"),
    ([A, B, ("R", "k", "a", 1, None)], "A"),
    ([A, B, ("R", "k", "a", 1, None), ("R", "k", "b", 1, None)], "UNKNOWN"),
    ([A, B, ("P", "k", "a", 2, "B"), ("R", "k", "a", 2, None)], "A"),
    ([A, B, ("P", "k", "a", 2, "B"), ("P", "k", "b", 2, "B"), A, B], "B"),
    ([("R", "k", "a", 1, None), A, B], "A"),
]


def frame(spark, traces):
    return spark.createDataFrame([(t, i, *e) for t, events in enumerate(traces) for i, e in enumerate(events)], SCHEMA)


def answers(df, column="predicted"):
    return {r["task"]: r[column] for r in df.collect()}


def test_hand_made_cases(spark):
    e = frame(spark, [c for c, _ in CASES])
    want = {i: w for i, (_, w) in enumerate(CASES)}
    assert answers(M.oracle(e), "expected") == want
    for policy in ("source", "gated", "protected"):
        assert answers(M.read(M.retain(e, policy, (1536,)), M.asked(e), policy)) == want
    assert answers(M.read_window(e, (1536,))) == want


def test_gate_needs_both_sources(spark):
    e = frame(spark, [[A]])
    assert answers(M.read(M.retain(e, "source", (1536,)), M.asked(e), "source")) == {0: "A"}
    assert answers(M.read(M.retain(e, "gated", (1536,)), M.asked(e), "gated")) == {0: "ABSTAIN"}


def test_latest_collapses_sources(spark):
    e = frame(spark, [[A, B, ("R", "k", "b", 1, None)]])
    assert answers(M.read(M.retain(e, "latest", (1536,)), M.asked(e), "latest")) == {0: "UNKNOWN"}
    assert answers(M.oracle(e), "expected") == {0: "A"}


def test_stale_replay_after_eviction_wins(spark):
    update = [("P", "k", "a", 2, "B"), ("P", "k", "b", 2, "B")]
    noise = [("P", f"d{i}", "a", 1, f"v{i}") for i in range(40)]
    e = frame(spark, [[A, B, *update, *noise, A, B]])
    got = M.read(M.retain(e, "protected", (384,)), M.asked(e), "protected").filter("key = 'k'")
    assert answers(got) == {0: "A"} and answers(M.oracle(e).filter("key = 'k'"), "expected") == {0: "B"}


def traces(n, seed=0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        events = []
        for i in range(rng.randint(0, 60)):
            op = "R" if rng.random() < 0.2 else "P"
            events.append((op, f"k{rng.randrange(6)}", rng.choice("ab"), rng.randint(1, 4), None if op == "R" else f"x{i}"))
        out.append(events)
    return out


@pytest.mark.parametrize("policy", M.POLICIES)
def test_fold_equals_plain_slots_and_keeps_the_budget(spark, policy):
    many = traces(12)
    budget = 200
    got = {r["task"]: r for r in M.retain(frame(spark, many), policy, (budget,)).collect()}
    for t, events in enumerate(many):
        if not events:
            continue
        s = M.Slots(M.POLICIES[policy], budget)
        for e in events:
            s.put(*e)
        rows = [((r["key"], r["source"]), (r["version"], r["value"])) for r in got[t]["rows"]]
        assert rows == list(s.rows.items())
        assert (got[t]["bytes"], got[t]["peak"]) == (s.size(), s.peak) and s.peak <= budget
        assert s.size() == len(s.text().encode())
    arrow = {r["task"]: r for r in M.retain_all(frame(spark, many), (policy,), (budget,)).collect()}
    for t, r in got.items():
        assert [x["value"] for x in r["rows"]] == [x["value"] for x in arrow[t]["rows"]] and (r["bytes"], r["peak"]) == (arrow[t]["bytes"], arrow[t]["peak"])


def test_unbounded_fold_equals_the_batch_rule(spark):
    e = frame(spark, traces(15, 3))
    a = {(r["task"], r["key"]): r["predicted"] for r in M.read(M.retain(e, "source", (10**6,)), M.asked(e), "source").collect()}
    b = {(r["task"], r["key"]): r["expected"] for r in M.oracle(e).collect()}
    c = {(r["task"], r["key"]): r["predicted"] for r in M.read_window(e, (10**6,)).collect()}
    assert a == b == c


def test_metrics_of_one_abstention(spark):
    df = spark.createDataFrame([("A", "ABSTAIN", False, 2, 2)], "expected string, predicted string, stale boolean, bytes int, peak int")
    r = M.metrics(df, ()).first()
    assert (r["accuracy"], r["stale_rate"], r["abstain_rate"]) == (0, 0, 1)


def test_record_bounded_maps(spark):
    rows = [(0, i, k, i) for i, k in enumerate("abcdefgha")] + [(0, 9, None, None), (0, 10, "i", 10)]
    e = spark.createDataFrame(rows, "task long, pos long, key string, value long")
    kept = lambda df: {r["key"]: r["value"] for r in df.collect()}
    assert kept(M.keyed(e)) == {**{k: i for i, k in enumerate("abcdefgh") if k not in "ab"}, "a": 8, "i": 10}
    assert kept(M.bounded_map(e)) == {**{k: i for i, k in enumerate("abcdefgh") if k != "a"}, "i": 10}
    assert kept(M.bounded_map(e, keep_first=True)) == {**{k: i for i, k in enumerate("abcdefgh") if k != "b"}, "i": 10}
    assert kept(M.recent(e)) == {"i": 10, "a": 8, "h": 7, "g": 6, "f": 5, "e": 4, "d": 3}

"""Rules of documents: a valid one of each kind, and what each change to it breaks."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallybrook.functions import checks as C
from tallybrook.functions import text as T
from tallybrook.plans import registry

PLAN = {
    "schema_version": 1, "title": "t", "question": "q", "hypothesis": "h", "experiment": "dir/run.py", "methods": ["a", "b_2"], "baseline": "a", "seeds": [1, 2], "primary_metric": "m",
    "direction": "maximize", "timeout_seconds": 10.5, "max_attempts": 1, "limitations": ["few"], "references": [{"title": "x", "url": "https://example.org", "note": ""}],
}
CAMPAIGN = {k: v for k, v in PLAN.items() if k not in ("methods", "seeds", "references")} | {
    "schema_version": 2, "candidates": ["b", "c"], "ablations": ["d"], "development_seeds": [1, 2], "holdout_seeds": [3, 4], "budget": {"max_attempts": 14, "max_timeout_seconds": 100},
    "search": {"max_trials": 2, "patience": 2, "min_improvement": 0}, "sources": [{"id": "s1", "title": "t", "url": "", "local_file": "f", "note": "n"}],
}
ASSIGNMENT = {
    "schema_version": 1, "task_id": "t", "model_alias": "m", "research_question": "q", "objective": "o", "boundaries": ["b"], "acceptance_checks": ["a"], "context_files": [], "evidence_ids": [],
    "max_output_tokens": 10**20,
}
FEEDBACK = {"reviewer": "r", "comments": [{"id": "1", "severity": "minor", "comment": "c", "action": "a"}, {"id": "2", "severity": "question", "comment": "c", "action": "a"}]}
RESULT = {"method": "a", "seed": 1, "metrics": {"m": 0.5, "n": 3}, "provenance": {}}
REVIEW = {"summary": "s", "strengths": ["x", ""], "issues": [{"severity": "major", "evidence_ids": ["e1"], "problem": "p", "action": "a"}], "next_experiments": []}
ROUTE = {
    "model": "x", "api_key_env": "KEY", "base_url": "https://host.example:8080/v1", "api_format": "chat", "token_budget": 1000, "input_token_reservation": 20, "max_input_bytes": 20,
    "max_output_tokens": 5, "timeout_seconds": 1800, "max_attempts": 3,
}
MODELS = {"schema_version": 1, "models": {"a": ROUTE, "b c": ROUTE | {"stream": False, "api_key_env_aliases": ["K2"]}}, "roles": {"critic": "b c"}}
RECEIPT = {
    "submission_confirmed": True, "destination": "https://paperreview.ai/", "venue": "ICLR", "paper_sha256": "p", "token_sha256": hashlib.sha256(b"tok").hexdigest(),
    "submitted_at": "2026-01-02T03:04:05.123456+00:00", "review_status": "pending",
}
PROJECT = {
    "schema_version": 5, "id": "test", "question": "q", "model_token_limit": 100,
    "stages": [
        {"id": "source", "adapter": "artifact", "review": False, "config": {"x": 1}}, {"id": "gate", "adapter": "artifact", "needs": ["source"], "role": "freeze"},
        {"id": "idea", "adapter": "proposal", "needs": ["source"], "role": "proposal"}, {"id": "paid", "adapter": "native_tasks", "token_limit": 5, "output_schema": {"type": "object"}},
        {"id": "held", "adapter": "tabular_experiment", "needs": ["gate"], "split": "holdout", "review": False, "max_attempts": 1},
    ],
}

FAMILIES = {
    "plan": (PLAN, C.plan), "campaign": (CAMPAIGN, C.campaign), "assignment": (ASSIGNMENT, C.assignment), "feedback": (FEEDBACK, C.feedback),
    "result": (RESULT, lambda d: C.result(d, F.lit("a"), F.lit(1), "m")), "review": (REVIEW, lambda d: C.review(d, F.array(F.lit("e1"), F.lit("e2")))), "models": (MODELS, C.models),
    "receipt": (RECEIPT, lambda d: C.receipt(d, F.lit("p"), F.lit("tok"))), "project": (PROJECT, C.project),
}
GONE = object()
#: family, path, new value, part of what is said
CHANGES = [
    ("plan", "extra", 1, "fields"), ("plan", "title", GONE, "fields"), ("plan", "title", "  \t", "texts"), ("plan", "schema_version", 2, "version"), ("plan", "schema_version", True, "version"),
    ("plan", "seeds", [1, 1], "seeds"), ("plan", "seeds", [True, 2], "seeds"), ("plan", "seeds", [1.0, 2], "seeds"), ("plan", "seeds", [1, 2**31], "seeds"), ("plan", "seeds", list(range(31)), "seeds"), ("plan", "seeds", "12", "seeds"),
    ("plan", "methods", ["a"], "methods"), ("plan", "methods", ["a", "B"], "methods"), ("plan", "methods", ["a", "b\n"], "methods"), ("plan", "methods", ["a", "a"], "methods"), ("plan", "baseline", "z", "baseline"), ("plan", "baseline", None, "baseline"),
    ("plan", "timeout_seconds", 0, "timeout"), ("plan", "timeout_seconds", 86400.5, "timeout"), ("plan", "timeout_seconds", True, "timeout"), ("plan", "timeout_seconds", "10", "timeout"), ("plan", "max_attempts", 4, "attempts"),
    ("plan", "direction", "up", "direction"), ("plan", "limitations", [], "limitations"), ("plan", "limitations", [1], "limitations"), ("plan", "experiment", "run.sh", "script"), ("plan", "references.0.url", "ftp://x", "references"),
    ("plan", "references.0.note", GONE, "references"), ("plan", "references", {}, "references"),
    ("campaign", "schema_version", 1, "fields"), ("campaign", "holdout_seeds", [2, 3], "both splits"), ("campaign", "ablations", ["b"], "no ablation"), ("campaign", "ablations", [], "ablations"), ("campaign", "baseline", "b", "neither"),
    ("campaign", "baseline", "B", "identifier"), ("campaign", "budget.max_attempts", 0, "budget"), ("campaign", "budget.max_timeout_seconds", 10, "budget"), ("campaign", "budget.more", 1, "budget"), ("campaign", "search.max_trials", 3, "search"),
    ("campaign", "search.min_improvement", -0.1, "search"), ("campaign", "limitations", [" "], "limitations"), ("campaign", "sources.0.url", "x", "sources"), ("campaign", "sources", [CAMPAIGN["sources"][0]] * 2, "sources"), ("campaign", "sources.0.title", "", "sources"),
    ("assignment", "objective", "", "text is empty"), ("assignment", "context_files", [" "], "list"), ("assignment", "boundaries", [], "boundaries"), ("assignment", "max_output_tokens", 0, "limit"), ("assignment", "max_output_tokens", 1.5, "limit"), ("assignment", "schema_version", "1", "fields"),
    ("feedback", "reviewer", None, "reviewer"), ("feedback", "comments", [], "no comments"), ("feedback", "comments.1.id", "1", "repeated"), ("feedback", "comments.0.severity", "fatal", "severity"), ("feedback", "comments.0.action", " ", "schema"), ("feedback", "comments.0.x", "y", "schema"),
    ("result", "method", "b", "identity"), ("result", "seed", 1.0, "identity"), ("result", "seed", True, "identity"), ("result", "metrics.m", GONE, "primary"), ("result", "metrics.n", True, "finite"), ("result", "metrics.n", None, "finite"), ("result", "metrics", [], "primary"),
    ("result", "provenance", [], "provenance"), ("result", "provenance", GONE, "provenance"),
    ("review", "summary", "", "summary"), ("review", "strengths", [1], "list"), ("review", "next_experiments", "x", "list"), ("review", "issues", {}, "issue"), ("review", "issues.0.severity", "low", "severity"), ("review", "issues.0.evidence_ids", ["e3"], "evidence"),
    ("review", "issues.0.evidence_ids", "e1", "evidence"), ("review", "issues.0.problem", " ", "empty"), ("review", "issues.0.note", "n", "schema"), ("review", "findings", [], "fields"),
    ("models", "schema_version", 2, "fields"), ("models", "models", {}, "fields"), ("models", "models.a.model", " ", "lacks"), ("models", "models.a.base_url", "https://u:p@host/", "address"), ("models", "models.a.base_url", "https://host/?q=1", "address"),
    ("models", "models.a.base_url", "https://host/#f", "address"), ("models", "models.a.base_url", "ws://host/", "address"), ("models", "models.a.base_url", "https:///x", "address"), ("models", "models.a.api_format", "rpc", "format"), ("models", "models.a.stream", 1, "stream"),
    ("models", "models.a.api_key_env_aliases", [" "], "aliases"), ("models", "models.a.token_budget", 0, "positive"), ("models", "models.a.token_budget", 1.0, "positive"), ("models", "models.a.max_output_tokens", GONE, "positive"), ("models", "models.a.max_attempts", 4, "three"),
    ("models", "models.a.timeout_seconds", 1801, "1800"), ("models", "models.a.max_input_bytes", 21, "reservation"), ("models", "roles.critic", "z", "alias"),
    ("receipt", "submission_confirmed", 1, "confirmed"), ("receipt", "destination", "http://paperreview.ai", "destination"), ("receipt", "venue", GONE, "venue"), ("receipt", "paper_sha256", "q", "paper"), ("receipt", "token_sha256", "0" * 64, "token"),
    ("receipt", "submitted_at", "2026-01-02T03:04:05", "zone"), ("receipt", "submitted_at", "2026-13-02T03:04:05Z", "zone"), ("receipt", "submitted_at", GONE, "zone"), ("receipt", "review_status", "accepted", "status"),
    ("project", "schema_version", 4, "fields"), ("project", "stages", [], "fields"), ("project", "id", "a b", "id or question"), ("project", "question", " ", "id or question"), ("project", "model_token_limit", -1, "limit of the project"), ("project", "model_token_limit", None, "limit of the project"),
    ("project", "stages.1.id", "source", "stage id"), ("project", "stages.1.id", "a b", "stage id"), ("project", "stages.0.adapter", "shell", "adapter"), ("project", "stages.1.needs", ["end"], "needs"), ("project", "stages.1.needs", ["source", "source"], "needs"),
    ("project", "stages.0.needs", ["source"], "needs"), ("project", "stages.1.review", "yes", "review is"), ("project", "stages.1.review", False, "decisions"), ("project", "stages.4.max_attempts", 0, "attempts"), ("project", "stages.4.split", "test", "split"),
    ("project", "stages.4.needs", ["source"], "freeze"), ("project", "stages.3.token_limit", 0, "paid"), ("project", "stages.3.token_limit", GONE, "paid"), ("project", "stages.0.token_limit", -1, "paid"), ("project", "stages.3.output_schema", "object", "schema"),
]


def changed(doc, path, value):
    doc = copy.deepcopy(doc)
    *way, last = (int(p) if p.isdigit() else p for p in path.split("."))
    at = doc
    for p in way:
        at = at[p]
    if value is GONE:
        del at[last]
    else:
        at[last] = value
    return doc


def judged(spark, family, docs):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").select("i", F.try_parse_json("t").alias("d"))
    return [r["e"] for r in rows.select("i", C.errors(F.col("d"), FAMILIES[family][1](F.col("d"))).alias("e")).orderBy("i").collect()]


@pytest.mark.parametrize("family", FAMILIES)
def test_each_fault_is_named_and_valid_documents_have_none(spark, family):
    own = [c for c in CHANGES if c[0] == family]
    got = judged(spark, family, [FAMILIES[family][0], None, "{", "[]", "null", *(changed(FAMILIES[family][0], *c[1:3]) for c in own)])
    assert got[0] == "" and got[1:3] == ["no document"] * 2 and got[3] and got[4]
    for (_, path, value, part), said in zip(own, got[5:], strict=True):
        assert part in said, (path, value, said)


def test_a_proposal_must_not_rest_on_a_holdout(spark):
    late = [*PROJECT["stages"], {"id": "sum", "adapter": "comparison", "needs": ["held"]}, {"id": "next", "adapter": "proposal", "role": "proposal", "needs": ["source", "sum"]}]
    assert judged(spark, "project", [PROJECT | {"stages": late}, PROJECT | {"stages": late[:-1]}]) == ["a proposal rests on a holdout", ""]


def test_bare_addresses(spark):
    good = ["http://h", "HTTPS://h/x", "http://[::1]:80/", "http://h/?", "http://h/#", "http://:@h/"]
    bad = ["http://", "h", "http://u@h", "http://h/a?b", "http://h#x", "//h"]
    docs = [changed(MODELS, "models.a.base_url", u) for u in good + bad]
    assert [e == "" for e in judged(spark, "models", docs)] == [True] * len(good) + [False] * len(bad)


def test_reserve_of_a_campaign(spark):
    df = spark.createDataFrame([(json.dumps(CAMPAIGN | {"max_attempts": 3}),)], "t string").select(F.try_parse_json("t").alias("d"))
    assert df.select(C.holdout_reserve(F.col("d"))).first()[0] == (2 * 2 + 3 * 2) * 3


def test_fences(spark):
    texts = ['{"a": 1}', ' ```json\n{"a": 1}\n``` ', '```\n{"a": 1}```', "[1]", "```json\n[1]\n```", "x", "", None, '```{"a": 1}```', '```json\n{"a": "```"}\n```']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", C.fenced_object(F.col("t")).isNotNull().alias("ok"), F.try_parse_json(C.fenced(F.col("t"))).isNotNull().alias("parsed")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [True, True, True, False, False, False, False, False, False, True]
    assert [r["parsed"] for r in got] == [True, True, True, True, True, False, False, False, True, True]


def test_texts_of_responses(spark):
    part = lambda t, kind="output_text": {"type": kind, "text": t}
    docs = [{"output_text": "x", "output": [{"type": "message", "content": [part("y")]}]}, {"output": [{"type": "reasoning", "content": [part("n")]}, {"type": "message", "content": [part("a"), part("n", "refusal"), part("b")]}, {"type": "message"}, {"type": "message", "content": [{"type": "output_text"}, part("c")]}]}, {}, {"output_text": 3}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    assert [r["x"] for r in df.select("i", C.response_text(F.try_parse_json("t")).alias("x")).orderBy("i").collect()] == ["x", "abc", "", ""]


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, json.dumps(FEEDBACK)), (2, "{}"), (3, None)], "id int, t string").withColumn("d", F.try_parse_json("t"))
    good, bad = C.sorted_out(rows, C.errors(F.col("d"), C.feedback(F.col("d"))))
    assert [r["id"] for r in good.collect()] == [1] and sorted((r["id"], r["errors"]) for r in bad.collect()) == [(2, "fields differ from the schema"), (3, "no document")]


def test_proposals(spark):
    good = {"hypothesis": "h", "parent": "p", "falsifier": "f", "expected_effect": "e", "evidence_refs": ["a"], "changes": {"x": 1, "b": 2}}
    docs = [good, good | {"hypothesis": " "}, good | {"evidence_refs": []}, good | {"changes": {}}, good | {"evidence_refs": ["z"]}, good | {"changes": {"b": 2, "x": 1}}, good | {"parent": "q"}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").select("i", F.try_parse_json("t").alias("d"))
    got = df.select("i", C.errors(F.col("d"), C.proposal(F.col("d"), F.array(F.lit("a")))).alias("e"), C.candidate(F.col("d")).alias("c")).orderBy("i").collect()
    assert [r["e"] for r in got] == ["", "a text is missing", *["evidence and a change are needed"] * 2, "unknown evidence", "", ""]
    assert got[0]["c"] == got[5]["c"] != got[6]["c"]


def test_files_that_are_not_shared(spark):
    key = "ghp_" + "a" * 30
    cases = {
        ("docs/a.txt", "x"): [], ("data/a.txt", "x"): ["private path"], ("config/projects/a.txt", "x"): [], ("config/projects/x/data/a.txt", ""): ["private path"], ("a/projects/b", ""): ["private path"], ("config/other/paper/a", ""): ["private path"],
        ("x/PaperReview-AccessToken.txt", ""): ["private path"], (".env", ""): ["credential file"], ("a/.env.local", ""): ["credential file"], (".env.example", ""): [], ("a.PDF", ""): ["large/binary artifact"], ("b/x.tar.zip", ""): ["large/binary artifact"],
        (".zip", ""): [], ("./data", ""): ["private path"], ("a.txt", key): ["possible credential"], ("vendor/.env", key): ["private path", "credential file", "possible credential"], ("big.txt", "é" * 2_500_001): ["large/binary artifact"], ("a", None): [],
    }
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(cases)], "i int, p string, t string")
    assert [r["f"] for r in df.select("i", T.share_issues(F.col("p"), F.col("t")).alias("f")).orderBy("i").collect()] == list(cases.values())


def test_literal_keys_are_redacted(spark):
    df = spark.createDataFrame([("a k1 b sk-abcdefghijklmnop k1", "k1"), ("a.b", "."), ("x", ""), ("x", None)], "t string, k string")
    assert [r[0] for r in df.select(T.redact(F.col("t"), key=F.col("k"))).collect()] == ["a [REDACTED] b [REDACTED] [REDACTED]", "a[REDACTED]b", "x", "x"]


def test_adapters_need_leave():
    free, all_ = registry.adapters(), registry.adapters(True, True)
    assert "stale_v5_readers" not in free and "comparison" in free and set(free) < set(all_) == set(registry.ADAPTER_QUERIES)

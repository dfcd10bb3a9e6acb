"""Rules for JSON documents (plans, campaigns, projects, model profiles, reviews, results, receipts) as Column predicates.

A document is a variant. Each family of documents is a function that takes it and gives a guard, without which nothing else
can be said, and rules: pairs of a condition and what is said where it fails. `errors` makes one column of them, and
`sorted_out` parts rows into those without errors and a quarantine that tells what is wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[Column, str]]

IDENTIFIER = r"\A[a-z][a-z0-9_]{0,39}\z"
NAME = r"\A[a-zA-Z0-9_-]+\z"
SHA256 = r"\A[0-9a-f]{64}\z"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
WEB = r"\Ahttps?://"
#: The adapters of project stages, and whether they are paid for or use the network.
ADAPTERS = {
    "artifact": (False, False), "literature_search": (False, True), "literature_cards": (False, False), "proposal": (False, False), "tabular_experiment": (False, False),
    "comparison": (False, False), "evidence_report": (False, False), "native_tasks": (True, False), "stale_v5_retrieval": (False, False), "stale_v5_readers": (True, False),
    "stale_v5_judges": (True, False), "stale_v5_analysis": (False, False), "manuscript_draft": (False, False),
}
SEVERITIES = ("major", "minor", "question")


# ------------------------------------------------ what a variant is
def field(v: Column, *names: str) -> Column:
    """The variant under these names; null where there is none."""
    for n in names:
        v = F.try_variant_get(v, f"$.{n}", "variant")
    return v


def _kind(v: Column, *starts: str) -> Column:
    kind = F.schema_of_variant(v)
    out = F.lit(False)
    for s in starts:
        out = out | F.startswith(kind, F.lit(s))
    return F.coalesce(out, F.lit(False))


def missing(v: Column) -> Column:
    return v.isNull()


def is_object(v: Column) -> Column:
    return _kind(v, "OBJECT<")


def is_list(v: Column) -> Column:
    return _kind(v, "ARRAY<")


def is_flag(v: Column) -> Column:
    return _kind(v, "BOOLEAN")


def is_string(v: Column) -> Column:
    return _kind(v, "STRING")


def said(v: Column) -> Column:
    """The string a variant holds; null if it holds something else."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def text(v: Column) -> Column:
    """Whether it is a string that isn't blank."""
    return _yes(said(v).rlike(NOT_BLANK))


def like(v: Column, pattern: str) -> Column:
    return _yes(said(v).rlike(pattern))


def one_of(v: Column, values) -> Column:
    return _yes(said(v).isin(*values))


def whole(v: Column, low: int | Column | None = None, high: int | Column | None = None) -> Column:
    """Whether it is a whole number written as one, within bounds; neither true nor 1.0 is."""
    n = F.try_variant_get(v, "$", "decimal(38,0)")
    ok = _kind(v, "BIGINT") | _yes(F.schema_of_variant(v).rlike(r"\ADECIMAL\((19|[23]\d),0\)\z"))
    if low is not None:
        ok = ok & (n >= low)
    return _yes(ok & (n <= high) if high is not None else ok)


def number(v: Column) -> Column:
    """Its value, if it is a finite number; else null."""
    x = F.when(_kind(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))
    return F.when(F.abs(x) < float("inf"), x)


def items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def strings(v: Column) -> Column:
    return F.transform(items(v), lambda x: F.coalesce(said(x), F.lit("")))


def fields_of(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def every(v: Column, rule: Callable[[Column], Column]) -> Column:
    """Whether it is a list whose items all keep the rule."""
    return is_list(v) & F.forall(items(v), rule)


def size(v: Column) -> Column:
    return F.size(items(v))


def distinct(v: Column) -> Column:
    """Whether no item of a list stands twice."""
    forms = F.transform(items(v), lambda x: F.to_json(x))
    return F.size(F.array_distinct(forms)) == F.size(forms)


def exactly(v: Column, names) -> Column:
    """Whether it is an object with these fields and no others."""
    return is_object(v) & (F.array_sort(F.map_keys(fields_of(v))) == F.array(*map(F.lit, sorted(names))))


def _identifiers(v: Column, least: int, most: int) -> Column:
    return every(v, lambda x: like(x, IDENTIFIER)) & F.size(items(v)).between(least, most) & distinct(v)


def _seeds(v: Column) -> Column:
    return every(v, lambda x: whole(x, 0, 2**31 - 1)) & size(v).between(2, 30) & distinct(v)


def _shared(d: Column) -> Rules:
    timeout = number(field(d, "timeout_seconds"))
    every_text = F.lit(True)
    for k in ("title", "question", "hypothesis", "experiment", "primary_metric"):
        every_text = every_text & text(field(d, k))
    return [
        (every_text, "texts must not be empty"),
        (one_of(field(d, "direction"), ("maximize", "minimize")), "direction is maximize or minimize"),
        (_yes((timeout > 0) & (timeout <= 86_400)), "timeout is within a day"),
        (whole(field(d, "max_attempts"), 1, 3), "one to three attempts"),
        (like(field(d, "experiment"), r"(?s)[^/]\.py\z"), "the experiment is a Python script"),
    ]


# ------------------------------------------------ the families
_SHARED = ("schema_version", "title", "question", "hypothesis", "experiment", "primary_metric", "direction", "timeout_seconds", "max_attempts", "limitations", "baseline")


def plan(d: Column) -> tuple[Column, Rules]:
    reference = lambda r: exactly(r, ("title", "url", "note")) & is_string(field(r, "title")) & is_string(field(r, "note")) & like(field(r, "url"), WEB)
    return exactly(d, (*_SHARED, "methods", "seeds", "references")), [
        (whole(field(d, "schema_version"), 1, 1), "unknown version"),
        *_shared(d),
        (_identifiers(field(d, "methods"), 2, 10), "two to ten distinct methods"),
        (_yes(F.array_contains(strings(field(d, "methods")), said(field(d, "baseline")))), "baseline is a method"),
        (_seeds(field(d, "seeds")), "two to thirty distinct seeds"),
        (every(field(d, "limitations"), is_string) & (size(field(d, "limitations")) > 0), "limitations are needed"),
        (every(field(d, "references"), reference), "references have a title, a web address and a note"),
    ]


def campaign(d: Column) -> tuple[Column, Rules]:
    candidates, ablations, baseline = strings(field(d, "candidates")), strings(field(d, "ablations")), said(field(d, "baseline"))
    dev, held, sources, budget, search = (field(d, k) for k in ("development_seeds", "holdout_seeds", "sources", "budget", "search"))
    address = lambda v: is_string(v) & ((said(v) == "") | like(v, WEB))
    source = lambda s: exactly(s, ("id", "title", "url", "local_file", "note")) & like(field(s, "id"), IDENTIFIER) & text(field(s, "title")) & text(field(s, "local_file")) & text(field(s, "note")) & address(field(s, "url"))
    ids = F.transform(items(sources), lambda s: said(field(s, "id")))
    forms = lambda v: F.transform(items(v), lambda x: F.to_json(x))
    trials = F.size(candidates)
    return exactly(d, (*_SHARED, "candidates", "ablations", "development_seeds", "holdout_seeds", "budget", "search", "sources")) & whole(field(d, "schema_version"), 2, 2), [
        *_shared(d),
        (like(field(d, "baseline"), IDENTIFIER), "baseline is an identifier"),
        (_identifiers(field(d, "candidates"), 1, 20), "one to twenty distinct candidates"),
        (_identifiers(field(d, "ablations"), 1, 8), "one to eight distinct ablations"),
        (~_yes(F.array_contains(F.concat(candidates, ablations), baseline)), "baseline is neither candidate nor ablation"),
        (~F.arrays_overlap(candidates, ablations), "a candidate is no ablation"),
        (_seeds(dev) & _seeds(held), "two to thirty distinct seeds"),
        (~F.arrays_overlap(forms(dev), forms(held)), "no seed is in both splits"),
        (exactly(budget, ("max_attempts", "max_timeout_seconds")) & whole(field(budget, "max_attempts"), 1) & _yes(number(field(budget, "max_timeout_seconds")) >= number(field(d, "timeout_seconds"))), "the budget admits no attempt"),
        (exactly(search, ("max_trials", "patience", "min_improvement")) & whole(field(search, "max_trials"), 1, trials) & whole(field(search, "patience"), 1, trials) & _yes(number(field(search, "min_improvement")) >= 0), "search out of range"),
        (every(field(d, "limitations"), text) & (size(field(d, "limitations")) > 0), "limitations are needed"),
        (every(sources, source) & (F.size(F.array_distinct(ids)) == F.size(ids)), "sources have an id of their own, texts and a web address"),
    ]


def holdout_reserve(d: Column) -> Column:
    """Attempts that a trial and the final comparisons of a campaign may still take."""
    n = lambda k: size(field(d, k))
    return (2 * n("development_seeds") + (2 + n("ablations")) * n("holdout_seeds")) * F.try_variant_get(field(d, "max_attempts"), "$", "long")


def assignment(d: Column) -> tuple[Column, Rules]:
    words, lists = ("task_id", "model_alias", "research_question", "objective"), ("boundaries", "acceptance_checks", "context_files", "evidence_ids")
    texts, lines = F.lit(True), F.lit(True)
    for k in words:
        texts = texts & text(field(d, k))
    for k in lists:
        lines = lines & every(field(d, k), text)
    return exactly(d, ("schema_version", "max_output_tokens", *words, *lists)) & whole(field(d, "schema_version"), 1, 1), [
        (texts, "a text is empty"),
        (lines, "a list holds something else than texts"),
        ((size(field(d, "boundaries")) > 0) & (size(field(d, "acceptance_checks")) > 0), "boundaries and checks are needed"),
        (whole(field(d, "max_output_tokens"), 1), "output limit out of range"),
    ]


def feedback(d: Column) -> tuple[Column, Rules]:
    names, comments = ("id", "severity", "comment", "action"), field(d, "comments")
    comment = lambda c: exactly(c, names) & text(field(c, "id")) & text(field(c, "severity")) & text(field(c, "comment")) & text(field(c, "action"))
    ids = F.transform(items(comments), lambda c: said(field(c, "id")))
    return exactly(d, ("reviewer", "comments")), [
        (text(field(d, "reviewer")), "reviewer is empty"),
        (is_list(comments) & (size(comments) > 0), "no comments"),
        (F.forall(items(comments), comment), "comment out of schema"),
        (F.size(F.array_distinct(ids)) == F.size(ids), "repeated id"),
        (F.forall(items(comments), lambda c: one_of(field(c, "severity"), SEVERITIES)), "unknown severity"),
    ]


def result(d: Column, method: Column, seed: Column, metric: str) -> tuple[Column, Rules]:
    """The result of a job that was to run `method` with `seed`."""
    metrics = field(d, "metrics")
    values = F.map_values(fields_of(metrics))
    return is_object(d), [
        (_yes(said(field(d, "method")) == method) & whole(field(d, "seed"), seed, seed), "identity differs"),
        (is_object(metrics) & F.map_contains_key(fields_of(metrics), metric), "the primary metric is missing"),
        (F.forall(values, lambda x: number(x).isNotNull()), "metrics are finite numbers"),
        (is_object(field(d, "provenance")), "no provenance"),
    ]


def review(d: Column, evidence: Column) -> tuple[Column, Rules]:
    """A model's review, which may cite the ids in `evidence`."""
    issues = field(d, "issues")
    names = ("severity", "evidence_ids", "problem", "action")
    return exactly(d, ("summary", "strengths", "issues", "next_experiments")), [
        (text(field(d, "summary")), "summary is empty"),
        (every(field(d, "strengths"), is_string) & every(field(d, "next_experiments"), is_string), "a list holds something else than texts"),
        (every(issues, lambda i: exactly(i, names)), "issue out of schema"),
        (F.forall(items(issues), lambda i: one_of(field(i, "severity"), SEVERITIES)), "unknown severity"),
        (F.forall(items(issues), lambda i: every(field(i, "evidence_ids"), lambda x: is_string(x) & F.array_contains(evidence, F.coalesce(said(x), F.lit(""))))), "unknown evidence"),
        (F.forall(items(issues), lambda i: text(field(i, "problem")) & text(field(i, "action"))), "an issue's text is empty"),
    ]


def _address(v: Column) -> Column:
    """A web address with a host, and without user, password, query or fragment."""
    url = said(v)
    host = F.regexp_extract(url, r"(?s)\A[hH][tT][tT][pP][sS]?://([^/?#]*)", 1)
    bare = ~url.rlike(r"(?s)\?[^#]|#.") & host.rlike(r"\A(:?@)?(\[[^\]]+\]|[^:\[@]+)(:[^@]*)?\z")
    return _yes(bare)


def models(d: Column) -> tuple[Column, Rules]:
    """A profile of model routes."""
    routes = field(d, "models")
    each = lambda rule: F.forall(F.map_values(fields_of(routes)), rule)
    counts = ("token_budget", "input_token_reservation", "max_input_bytes", "max_output_tokens", "timeout_seconds", "max_attempts")

    def all_of(rule, names):
        def ok(m):
            out = F.lit(True)
            for k in names:
                out = out & rule(field(m, k))
            return out

        return ok

    amount = lambda m, k: F.try_variant_get(field(m, k), "$", "decimal(38,0)")
    roles = F.map_values(fields_of(field(d, "roles")))
    return whole(field(d, "schema_version"), 1, 1) & is_object(routes) & (F.size(F.map_keys(fields_of(routes))) > 0), [
        (each(all_of(text, ("model", "api_key_env", "base_url"))), "a route lacks a field"),
        (each(lambda m: _address(field(m, "base_url"))), "a base URL is no plain web address"),
        (each(lambda m: one_of(field(m, "api_format"), ("chat", "responses"))), "unknown API format"),
        (each(lambda m: missing(field(m, "stream")) | is_flag(field(m, "stream"))), "stream is true or false"),
        (each(lambda m: missing(field(m, "api_key_env_aliases")) | every(field(m, "api_key_env_aliases"), text)), "aliases of keys are names"),
        (each(all_of(lambda v: whole(v, 1), counts)), "a limit is no positive whole number"),
        (each(lambda m: _yes((amount(m, "max_attempts") <= 3) & (amount(m, "timeout_seconds") <= 1800))), "at most three attempts of 1800 seconds"),
        (each(lambda m: _yes(amount(m, "input_token_reservation") >= amount(m, "max_input_bytes"))), "reservation below the input's bytes"),
        (F.forall(roles, lambda r: _yes(F.map_contains_key(fields_of(routes), said(r)))), "a role has an unknown alias"),
    ]


def receipt(d: Column, paper: Column, token: Column) -> tuple[Column, Rules]:
    """A receipt of a submission; it must be bound to this paper (its SHA-256) and this token."""
    at = said(field(d, "submitted_at"))
    zoned = at.rlike(r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d{1,6})?)?(Z|[+-]\d\d:?\d\d(:?\d\d)?)\z") & F.try_to_timestamp(F.regexp_replace(F.substring(at, 1, 16), "T", " "), F.lit("yyyy-MM-dd HH:mm")).isNotNull()
    return is_object(d), [
        (_yes(is_flag(field(d, "submission_confirmed")) & F.try_variant_get(field(d, "submission_confirmed"), "$", "boolean")), "not confirmed"),
        (_yes(F.rtrim(said(field(d, "destination")), F.lit("/")) == "https://paperreview.ai"), "unexpected destination"),
        (one_of(field(d, "venue"), ("ICLR",)), "unexpected venue"),
        (_yes((token != "") & ~F.startswith(token, F.lit("sk-"))), "no valid token"),
        (_yes(said(field(d, "paper_sha256")) == paper), "another paper"),
        (_yes(said(field(d, "token_sha256")) == F.sha2(token, 256)), "another token"),
        (_yes(zoned), "time has no zone"),
        (one_of(field(d, "review_status"), ("pending", "completed", "failed")), "unknown status"),
    ]


def project(d: Column, adapters: dict[str, tuple[bool, bool]] = ADAPTERS) -> tuple[Column, Rules]:
    """A project: stages in order, each with needs, a role, a split and limits."""
    stages = field(d, "stages")
    numbered = F.transform(items(stages), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    ids = F.transform(items(stages), lambda s: F.coalesce(said(field(s, "id")), F.lit("")))
    before = lambda i: F.slice(ids, 1, i)
    each = lambda rule: F.forall(numbered, lambda n: rule(n["s"], n["i"]))
    or_else = lambda v, rule, when_missing=True: F.when(missing(v), F.lit(when_missing)).otherwise(rule)
    needs = lambda s: strings(field(s, "needs"))
    reviewed = lambda s: or_else(field(s, "review"), _yes(F.try_variant_get(field(s, "review"), "$", "boolean")))
    role = lambda s, *names: one_of(field(s, "role"), names)
    held = lambda s: one_of(field(s, "split"), ("holdout",))
    gates = F.transform(F.filter(items(stages), lambda s: role(s, "freeze") & reviewed(s)), lambda s: F.coalesce(said(field(s, "id")), F.lit("")))
    # ids of holdouts and of all that rest on them, in one walk along the stages
    tainted = F.aggregate(items(stages), F.array().cast("array<string>"), lambda seen, s: F.when(held(s) | F.arrays_overlap(seen, needs(s)), F.concat(seen, F.array(F.coalesce(said(field(s, "id")), F.lit(""))))).otherwise(seen))
    paid = F.array(*(F.lit(k) for k, (p, _) in adapters.items() if p)).cast("array<string>")
    cap = lambda s: field(s, "token_limit")
    schema = lambda s: field(s, "output_schema")
    limit = field(d, "model_token_limit")
    return whole(field(d, "schema_version"), 5, 5) & is_list(stages) & (size(stages) > 0) & F.forall(items(stages), is_object), [
        (like(field(d, "id"), NAME) & text(field(d, "question")), "id or question is wrong"),
        (or_else(limit, whole(limit, 0)), "token limit of the project is wrong"),
        (each(lambda s, i: like(field(s, "id"), NAME) & ~F.array_contains(before(i), F.coalesce(said(field(s, "id")), F.lit("")))), "bad or repeated stage id"),
        (each(lambda s, i: one_of(field(s, "adapter"), tuple(adapters))), "unknown adapter"),
        (each(lambda s, i: or_else(field(s, "needs"), every(field(s, "needs"), is_string) & distinct(field(s, "needs")) & (F.size(F.array_except(needs(s), before(i))) == 0))), "needs must be unique and stand before"),
        (each(lambda s, i: or_else(field(s, "review"), is_flag(field(s, "review")))), "review is true or false"),
        (each(lambda s, i: ~role(s, "proposal", "freeze", "interpretation") | reviewed(s)), "decisions are reviewed"),
        (each(lambda s, i: or_else(field(s, "max_attempts"), whole(field(s, "max_attempts"), 1))), "attempts of a stage are wrong"),
        (each(lambda s, i: or_else(field(s, "split"), one_of(field(s, "split"), ("development", "holdout")))), "unknown split"),
        (each(lambda s, i: ~held(s) | F.arrays_overlap(needs(s), gates)), "a holdout needs a reviewed freeze"),
        (each(lambda s, i: ~role(s, "proposal", "literature") | ~F.arrays_overlap(needs(s), tainted)), "a proposal rests on a holdout"),
        (each(lambda s, i: or_else(cap(s), whole(cap(s), 0), True) & (~F.array_contains(paid, F.coalesce(said(field(s, "adapter")), F.lit(""))) | whole(cap(s), 1))), "paid stages need a token limit"),
        (each(lambda s, i: missing(schema(s)) | is_object(schema(s)) | is_flag(schema(s))), "a result's schema is no schema"),
    ]


def proposal(d: Column, known: Column) -> tuple[Column, Rules]:
    """A proposed change, which may cite the stages in `known`."""
    texts = F.lit(True)
    for k in ("hypothesis", "parent", "falsifier", "expected_effect"):
        texts = texts & text(field(d, k))
    refs, changes = field(d, "evidence_refs"), field(d, "changes")
    return is_object(d), [
        (texts, "a text is missing"),
        (is_list(refs) & (size(refs) > 0) & is_object(changes) & (F.size(F.map_keys(fields_of(changes))) > 0), "evidence and a change are needed"),
        (F.forall(items(refs), lambda r: is_string(r) & F.array_contains(known, F.coalesce(said(r), F.lit("")))), "unknown evidence"),
    ]


def candidate(d: Column) -> Column:
    """The fingerprint of a proposal: its parent and its changes."""
    return F.sha2(F.concat_ws("|", said(field(d, "parent")), F.to_json(field(d, "changes"))), 256)


# ------------------------------------------------ rows
def fenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    t = F.regexp_replace(F.regexp_replace(reply, r"(?U)\A[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+\z", "")
    closed = F.startswith(t, F.lit("```")) & F.endswith(t, F.lit("```"))
    body = F.when(F.startswith(t, F.lit("```json")), F.substring(t, 8, 1 << 30)).otherwise(F.substring(t, 4, 1 << 30))
    return F.when(closed, F.left(body, F.greatest(F.length(body) - 3, F.lit(0)))).otherwise(t)


def fenced_object(reply: Column) -> Column:
    """The variant of a reply that is one JSON object, bare or between a fence's first and last line; else null."""
    t = F.regexp_replace(reply, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    inside = F.regexp_extract(t, r"(?s)\A```[^\n]*\n(.*?)(?:```(?!.*```).*)?\z", 1)
    v = F.try_parse_json(F.when(F.startswith(t, F.lit("```")), inside).otherwise(t))
    return F.when(is_object(v), v)


def response_text(d: Column) -> Column:
    """The text of a model's response: its `output_text`, or else all texts of its messages in order."""
    parts = lambda item: F.filter(items(field(item, "content")), lambda p: one_of(field(p, "type"), ("output_text",)))
    messages = F.filter(items(field(d, "output")), lambda i: one_of(field(i, "type"), ("message",)))
    texts = F.flatten(F.transform(messages, lambda i: F.transform(parts(i), lambda p: F.coalesce(said(field(p, "text")), F.lit("")))))
    return F.coalesce(said(field(d, "output_text")), F.array_join(texts, ""))


def errors(d: Column, family: tuple[Column, Rules], guard: str = "fields differ from the schema") -> Column:
    """What is wrong with a document, joined by `; `; empty if nothing is. d: the variant, null where there is none."""
    sound, rules = family
    found = F.array_compact(F.array(*(F.when(~_yes(ok), F.lit(message)) for ok, message in rules)))
    return F.when(d.isNull(), F.lit("no document")).when(~_yes(sound), F.lit(guard)).otherwise(F.array_join(found, "; "))


def sorted_out(rows: DataFrame, judged: Column) -> tuple[DataFrame, DataFrame]:
    """The rows without errors, and the quarantine: the others, with `errors`."""
    told = rows.withColumn("errors", judged)
    return told.filter("errors = ''").drop("errors"), told.filter("errors <> ''")

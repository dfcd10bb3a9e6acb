"""Checks of documents, which the rows of the tables make up; and their SQL, which parses the same documents by itself.

A document's text is one SQL expression over a group of rows, in a dialect each for Spark and DuckDB. What is wrong with it
follows from the rows: prices beyond a limit, priorities that are no identifiers, customers with a single order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks as C
from ..sources import tables as S


@dataclass(frozen=True)
class Dialect:
    list: Callable[[str], str]
    set: Callable[[str], str]
    sha: Callable[[str], str]
    string: str


SPARK = Dialect(lambda x: f"array_join(array_sort(collect_list({x})), ', ')", lambda x: f"array_join(array_sort(collect_set({x})), ', ')", lambda x: f"sha2({x}, 256)", "STRING")
DUCK = Dialect(lambda x: f"coalesce(string_agg({x}, ', ' ORDER BY {x}), '')", lambda x: f"coalesce(string_agg(DISTINCT {x}, ', ' ORDER BY {x}), '')", lambda x: f"sha256({x})", "VARCHAR")

_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'not specified' ELSE 'low' END"


_LOST, _DEAR, _BLANK = "o_orderstatus = 'P'", "o_totalprice > 300000", "' '"


def _q(x: str) -> str:
    return f"""'"' || {x} || '"'"""


def _escaped(x: str) -> str:
    for code, short in ((92, "chr(92)"), (34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
        x = f"replace({x}, chr({code}), chr(92) || {short})"
    return x


def _whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def _count(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def _object(**parts: str) -> str:
    """JSON text of an object, from SQL expressions of its values' texts."""
    return "'{' || " + " || ', ' || ".join(f"""'"{k}": ' || {v}""" for k, v in parts.items()) + " || '}'"


def _array(x: str) -> str:
    return f"'[' || {x} || ']'"


_HEAD = {
    "title": "CASE WHEN count(*) > 1 THEN '\"Orders\"' ELSE '\" \"' END", "question": "'\"q\"'", "hypothesis": "'\"h\"'", "primary_metric": "'\"price\"'",
    "experiment": "CASE WHEN min(o_totalprice) < 12000 THEN '\"run.sh\"' ELSE '\"run.py\"' END",
    "direction": "CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN '\"both\"' ELSE '\"maximize\"' END", "timeout_seconds": _whole("max(o_totalprice) / 5.5"),
}


def _plan(g: Dialect) -> str:
    reference = _object(title=_q("o_orderkey"), url="CASE WHEN o_totalprice > 480000 THEN '\"ftp://x\"' ELSE '\"https://x\"' END") + " || ''"
    reference = f"CASE WHEN o_orderstatus = 'F' THEN replace({reference}, '}}', CASE WHEN o_totalprice < 15000 THEN '}}' ELSE ', \"note\": \"n\"}}' END) END"
    body = _object(
        schema_version="CASE WHEN count(*) = 2 THEN 2 ELSE 1 END", **_HEAD, max_attempts=f"(1 + {_count(_LOST)})",
        methods=_array(g.set(f"CASE WHEN o_totalprice > 100000 THEN {_q(_PRIORITY)} END")), baseline="'\"high\"'", seeds=_array(g.list("'' || o_orderkey")),
        limitations=_array(g.set(f"CASE WHEN o_totalprice > 200000 THEN {_q('o_orderstatus')} END")), references=_array(g.list(reference)),
    )
    return f"CASE WHEN count(*) > 17 THEN '{{}}' ELSE {body} END"


def _campaign(g: Dialect) -> str:
    slug = lambda s, end: g.set(f"CASE WHEN o_orderstatus = '{s}' AND o_totalprice > 250000 THEN {_q(_PRIORITY + end)} END")
    source = _object(id=_q("CASE WHEN o_totalprice < 20000 THEN 'S' ELSE 's' END || o_orderkey"), title="'\"t\"'", url="CASE WHEN o_totalprice > 460000 THEN '\"x\"' ELSE '\"\"' END", local_file="'\"f\"'", note="'\"n\"'")
    return _object(
        schema_version="2", **_HEAD, max_attempts="(CASE WHEN count(*) > 14 THEN 4 ELSE 2 END)", baseline="'\"base\"'", candidates=_array(slug("F", "")), ablations=_array(slug("O", " || CASE WHEN o_totalprice > 400000 THEN '' ELSE '_x' END")),
        development_seeds=_array(g.list("CASE WHEN o_orderstatus = 'F' THEN '' || (o_orderkey % 50) END")), holdout_seeds=_array(g.list("CASE WHEN o_orderstatus = 'O' THEN '' || (o_orderkey % 50) END")),
        budget=_object(max_attempts="count(*)", max_timeout_seconds=_whole("sum(o_totalprice) / 15")),
        search=_object(max_trials=f"(CASE WHEN {_count(_DEAR)} > 2 THEN 1 ELSE 2 END)", patience="1", min_improvement="0.5"), limitations=_array(g.set(_q("o_orderstatus"))),
        sources=_array(g.list(f"CASE WHEN o_orderstatus = 'P' THEN {source} END")),
    )


def _assignment(g: Dialect) -> str:
    said = lambda role, n: f"max(CASE WHEN role = '{role}' THEN {_escaped(f'substr(text, 1, {n})')} ELSE '' END)"
    return _object(
        schema_version="CASE WHEN count(*) > 11 THEN 2 ELSE 1 END", task_id=_q("max(conv_id)"), model_alias="'\"m\"'", research_question=_q(said("user", 30)), objective=_q(f"{said('system', 20)} || 'o'"),
        boundaries=_array(g.set(f"CASE WHEN length(text) < 900 THEN {_q('role')} END")), acceptance_checks=_array(g.list(f"CASE WHEN role = 'assistant' THEN {_q('turn')} END")),
        context_files=_array(g.set(f"CASE WHEN length(text) > 3000 THEN {_q(_BLANK)} END")), evidence_ids=_array(g.list(_q("turn"))), max_output_tokens="(sum(length(text)) - 1500)",
    )


def _feedback(g: Dialect) -> str:
    severity = "CASE WHEN length(text) > 1500 THEN '\"fatal\"' WHEN length(text) > 600 THEN '\"major\"' ELSE '\"minor\"' END"
    comment = _object(id=_q("(length(text) % 97)"), severity=severity, comment=_q(_escaped("substr(text, 1, 60)")), action="CASE WHEN length(text) < 60 THEN '\" \"' ELSE '\"a\"' END")
    return _object(reviewer="CASE WHEN count(*) = 2 THEN '\"\"' ELSE '\"r\"' END", comments=_array(g.list(f"CASE WHEN role = 'assistant' THEN {comment} END")))


def _result(g: Dialect) -> str:
    metrics = f"CASE WHEN o_orderstatus = 'P' THEN '{{}}' WHEN o_totalprice < 15000 THEN '{{\"price\": \"low\"}}' ELSE {_object(price=_whole('o_totalprice'), rank='0.25')} END"
    return _object(method=_q(_PRIORITY), seed="CASE WHEN o_totalprice > 450000 THEN o_custkey ELSE o_orderkey END", metrics=metrics, provenance="CASE WHEN o_totalprice < 40000 THEN 'null' ELSE '{}' END")


def _review(g: Dialect) -> str:
    severity = "CASE WHEN length(text) > 1200 THEN '\"major\"' WHEN length(text) > 300 THEN '\"minor\"' WHEN length(text) > 120 THEN '\"question\"' ELSE '\"low\"' END"
    issue = _object(severity=severity, evidence_ids=_array(f"{_q('turn')} || ', ' || {_q('conv_id')}"), problem=_q(_escaped("substr(text, 1, 25)")), action="CASE WHEN length(text) > 3000 THEN '\"\"' ELSE '\"a\"' END")
    body = _object(summary=_q(_escaped("substr(text, 1, 40)")), strengths=f"CASE WHEN length(text) < 200 THEN '[1]' ELSE {_array(_q('role'))} END", issues=_array(issue), next_experiments="'[]'")
    return f"CASE turn % 4 WHEN 1 THEN '```json' || chr(10) || {body} || chr(10) || '```' WHEN 2 THEN '  ```' || {body} || '``` ' ELSE {body} END"


def _models(g: Dialect) -> str:
    url = "CASE WHEN s_acctbal < -500 THEN '\"https://u:p@x/\"' WHEN s_acctbal < 0 THEN '\"https://x/?q=1\"' WHEN s_acctbal > 9500 THEN '\"x/v1\"' ELSE '\"https://x/v1\"' END"
    route = _object(
        model=_q("s_name"), api_key_env="CASE WHEN s_nationkey = 3 THEN '\" \"' ELSE '\"KEY\"' END", base_url=url, api_format="CASE WHEN s_nationkey = 7 THEN '\"rpc\"' ELSE '\"chat\"' END", stream="CASE WHEN s_nationkey = 9 THEN '1' ELSE 'true' END",
        api_key_env_aliases="CASE WHEN s_nationkey = 11 THEN '[\"\"]' ELSE '[]' END", token_budget=_whole("s_acctbal * 100"), input_token_reservation=_whole("abs(s_acctbal) + 1"), max_input_bytes="200", max_output_tokens="100",
        timeout_seconds=_whole("abs(s_acctbal) / 5 + 1"), max_attempts="CASE WHEN s_nationkey = 13 THEN 4 ELSE 3 END",
    )
    return _object(schema_version="CASE WHEN s_nationkey = 15 THEN 2 ELSE 1 END", models=f"'{{' || {_q('s_name')} || ': ' || {route} || '}}'", roles=_object(reader="CASE WHEN s_acctbal > 8000 THEN '\"other\"' ELSE " + _q("s_name") + " END"))


def _receipt(g: Dialect) -> str:
    day = f"CAST(CAST(o_orderdate AS DATE) AS {g.string})"
    return _object(
        submission_confirmed="CASE WHEN o_orderstatus = 'P' THEN 'false' ELSE 'true' END", destination="CASE WHEN o_orderpriority = '1-URGENT' THEN '\"http://paperreview.ai\"' WHEN o_orderpriority = '2-HIGH' THEN '\"https://paperreview.ai/\"' ELSE '\"https://paperreview.ai\"' END",
        venue="CASE WHEN o_totalprice > 450000 THEN 'null' ELSE '\"ICLR\"' END", paper_sha256=_q(g.sha("'' || o_orderkey")), token_sha256=_q(g.sha("CASE WHEN o_totalprice < 50000 THEN 'other' ELSE 'token' || o_custkey END")),
        submitted_at=_q(f"{day} || CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'T10:00:00' ELSE 'T10:00:00.25+02:00' END"), review_status="CASE o_orderstatus WHEN 'F' THEN '\"completed\"' WHEN 'O' THEN '\"pending\"' ELSE '\"lost\"' END",
    )


def _project(g: Dialect) -> str:
    stage = _object(
        id=_q("lpad('' || o_orderkey, 9, '0') || CASE WHEN o_totalprice < 5000 THEN '!' ELSE '' END"),
        adapter="CASE WHEN o_totalprice > 495000 THEN '\"shell\"' WHEN o_orderpriority = '2-HIGH' THEN '\"native_tasks\"' ELSE '\"artifact\"' END",
        needs="CASE WHEN before IS NULL THEN '[]' WHEN o_totalprice BETWEEN 5000 AND 8000 THEN '[\"later\"]' ELSE '[\"' || lpad('' || before, 9, '0') || '\"]' END",
        role="CASE o_orderpriority WHEN '1-URGENT' THEN '\"freeze\"' WHEN '3-MEDIUM' THEN '\"literature\"' ELSE 'null' END", review="CASE WHEN o_totalprice > 430000 THEN 'false' ELSE 'true' END",
        split="CASE WHEN o_totalprice BETWEEN 300000 AND 320000 THEN '\"holdout\"' ELSE '\"development\"' END", max_attempts="CASE WHEN o_totalprice BETWEEN 8000 AND 9000 THEN 0 ELSE 2 END", token_limit=_whole("o_totalprice / 15000"),
    )
    return _object(schema_version="CASE WHEN count(*) = 3 THEN 4 ELSE 5 END", id=_q("'c' || max(o_custkey)"), question="'\"q\"'", model_token_limit=f"(100 - {_count('o_totalprice > 470000')} * 60)", stages=_array(g.list(stage)))


def _proposal(g: Dialect) -> str:
    change = _object(size=_whole("max(o_totalprice) / 100000"))
    return _object(
        hypothesis="CASE WHEN count(*) > 15 THEN '\" \"' ELSE '\"h\"' END", parent=_q("min(o_orderpriority)"), falsifier="'\"f\"'", expected_effect="'\"e\"'",
        evidence_refs=_array(g.set(f"CASE WHEN o_totalprice > 420000 THEN {_q('o_orderstatus')} END")), changes=f"CASE WHEN min(o_totalprice) > 60000 THEN '{{}}' ELSE {change} END",
    )


# ------------------------------------------------ Spark
def _made(rows: DataFrame, key: str, text: Callable[[Dialect], str], grouped: bool = True) -> DataFrame:
    """id, doc, d: the documents of the rows, as text and as variants."""
    text = F.expr(text(SPARK))
    docs = rows.groupBy(F.col(key).alias("id")).agg(text.alias("doc")) if grouped else rows.select(F.col(key).alias("id"), text.alias("doc"), *rows.columns)
    return docs.withColumn("d", F.try_parse_json("doc"))


def _judged(docs: DataFrame, family, *more) -> DataFrame:
    return docs.select("id", C.errors(F.col("d"), family(F.col("d"), *more)).alias("errors"))


def check_plans(spark, d):
    return _judged(_made(S.table(spark, d, "orders"), "o_custkey", _plan), C.plan)


def check_campaigns(spark, d):
    return _judged(_made(S.table(spark, d, "orders"), "o_custkey", _campaign), C.campaign)


def campaign_reserves(spark, d):
    """Attempts that a customer's campaign must hold back, and whether its budget has them."""
    docs = _made(S.table(spark, d, "orders"), "o_custkey", _campaign)
    held = F.try_variant_get(F.col("d"), "$.budget.max_attempts", "long")
    return docs.select("id", C.holdout_reserve(F.col("d")).cast("long").alias("needed"), (held >= C.holdout_reserve(F.col("d"))).alias("admitted"))


def check_assignments(spark, d):
    return _judged(_made(S.table(spark, d, "conversations"), "conv_id", _assignment), C.assignment)


def check_feedback(spark, d):
    return _judged(_made(S.table(spark, d, "conversations"), "conv_id", _feedback), C.feedback)


def check_results(spark, d):
    docs = _made(S.table(spark, d, "orders"), "o_orderkey", _result, grouped=False)
    method = F.when(F.col("o_totalprice") > 440_000, "low").otherwise(F.expr(_PRIORITY))
    return _judged(docs, lambda v: C.result(v, method, F.col("o_orderkey"), "price"))


def check_proposals(spark, d):
    """Each customer's proposal; of valid ones with one fingerprint the first counts."""
    docs = _made(S.table(spark, d, "orders"), "o_custkey", _proposal)
    told = docs.select("id", C.errors(F.col("d"), C.proposal(F.col("d"), F.array(F.lit("F"), F.lit("O")))).alias("errors"), C.candidate(F.col("d")).alias("candidate"))
    first = told.filter("errors = ''").groupBy("candidate").agg(F.min("id").alias("first"))
    again = F.coalesce((F.col("errors") == "") & (F.col("id") > F.col("first")), F.lit(False))
    return told.join(first, "candidate", "left").select("id", F.when(again, "duplicate candidate").otherwise(F.col("errors")).alias("errors"))


def _replies(spark, d) -> DataFrame:
    turns = S.table(spark, d, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.expr(_review(SPARK)).alias("reply"))


def check_reviews(spark, d):
    docs = _replies(spark, d).withColumn("d", F.try_parse_json(C.fenced(F.col("reply"))))
    evidence = F.array(F.lit("1"), F.lit("3"), F.lit("5"), F.col("conv_id").cast("string"))
    return _judged(docs, lambda v: C.review(v, evidence))


def review_issues(spark, d):
    """The issues of valid reviews by severity, and how many replies are in quarantine."""
    docs = _replies(spark, d).withColumn("d", F.try_parse_json(C.fenced(F.col("reply"))))
    evidence = F.array(F.lit("1"), F.lit("3"), F.lit("5"), F.col("conv_id").cast("string"))
    good, bad = C.sorted_out(docs, C.errors(F.col("d"), C.review(F.col("d"), evidence)))
    issues = good.select(F.explode(C.items(C.field(F.col("d"), "issues"))).alias("i")).select(C.said(C.field(F.col("i"), "severity")).alias("state"))
    return issues.union(bad.select(F.lit("quarantine").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


def reply_objects(spark, d):
    """Replies that hold one JSON object, fenced or not, and its first field."""
    v = C.fenced_object(F.col("reply"))
    return _replies(spark, d).select("id", v.isNotNull().alias("object"), C.said(C.field(v, "summary")).alias("summary"))


def _responses(g: Dialect) -> str:
    """Responses of two shapes: a text as it is, or messages of parts of which some are texts."""
    part = _object(type="CASE WHEN turn % 5 = 0 THEN '\"refusal\"' ELSE '\"output_text\"' END", text=_q(_escaped("substr(text, 1, 50)")))
    item = _object(type="CASE WHEN role = 'user' THEN '\"reasoning\"' ELSE '\"message\"' END", content=_array(f"{part} || ', ' || {part}"))
    whole = _object(output_text=_q(_escaped("max(substr(text, 1, 30))")), output="'[]'")
    return f"CASE WHEN count(*) % 3 = 0 THEN {whole} ELSE {_object(output=_array(g.list(item)))} END"


def response_texts(spark, d):
    return _made(S.table(spark, d, "conversations").filter("text IS NOT NULL"), "conv_id", _responses).select("id", C.response_text(F.col("d")).alias("text"))


def check_routes(spark, d):
    return _judged(_made(S.table(spark, d, "supplier"), "s_suppkey", _models, grouped=False), C.models)


def check_receipts(spark, d):
    docs = _made(S.table(spark, d, "orders"), "o_orderkey", _receipt, grouped=False)
    paper = F.sha2(F.when(F.col("o_totalprice") > 420_000, "changed").otherwise(F.col("o_orderkey").cast("string")), 256)
    token = F.when(F.col("o_custkey") % 50 == 0, F.concat(F.lit("sk-"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("token"), F.col("o_custkey").cast("string")))
    return _judged(docs, lambda v: C.receipt(v, paper, token))


def check_projects(spark, d):
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return _judged(_made(S.table(spark, d, "orders").withColumn("before", before), "o_custkey", _project), C.project)


# ------------------------------------------------ DuckDB
def _of(path: str, source: str = "doc") -> str:
    return f"json_extract({source}, '$.{path}')" if path else source


def _type(x: str, *kinds: str) -> str:
    return f"coalesce(json_type({x}) IN ({', '.join(repr(k) for k in kinds)}), false)"


def _string(x: str) -> str:
    return f"(({x})->>'$')"


def _matches(x: str, pattern: str, whole: bool = True) -> str:
    f = "regexp_full_match" if whole else "regexp_matches"
    return f"({_type(x, 'VARCHAR')} AND {f}({_string(x)}, '{pattern}'))"


def _text(x: str) -> str:
    return _matches(x, r"\S", False)


def _int(x: str, low: str | int | None = None, high: str | int | None = None) -> str:
    ok = _type(x, "UBIGINT", "BIGINT")
    for bound, sign in ((low, ">="), (high, "<=")):
        if bound is not None:
            ok += f" AND coalesce(TRY_CAST({_string(x)} AS BIGINT) {sign} {bound}, false)"
    return f"({ok})"


def _number(x: str) -> str:
    return f"(CASE WHEN {_type(x, 'UBIGINT', 'BIGINT', 'DOUBLE')} THEN CAST({_string(x)} AS DOUBLE) END)"


def _items(x: str) -> str:
    return f"coalesce(CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') END, [])"


def _all(values: str, rule: str, name: str = "x") -> str:
    return f"(len(list_filter({values}, lambda {name}: NOT coalesce({rule}, false))) = 0)"


def _every(x: str, rule: str, name: str = "x") -> str:
    return f"({_type(x, 'ARRAY')} AND {_all(_items(x), rule, name)})"


def _once(values: str) -> str:
    return f"(len(list_distinct({values})) = len({values}))"


def _keys(x: str, *names: str) -> str:
    return f"({_type(x, 'OBJECT')} AND list_sort(json_keys({x})) = [{', '.join(repr(n) for n in sorted(names))}])"


def _strings(x: str) -> str:
    return f"list_transform({_items(x)}, lambda y: (y->>'$'))"


def _within(x: str, low: int, high: int) -> str:
    return f"(len({_items(x)}) BETWEEN {low} AND {high})"


_IDENT, _WEB = "[a-z][a-z0-9_]{0,39}", "https?://.*"
_SEEDS = lambda p: f"({_every(_of(p), _int('x', 0, 2**31 - 1))} AND {_within(_of(p), 2, 30)} AND {_once(_items(_of(p)))})"
_IDS = lambda p, low, high: f"({_every(_of(p), _matches('x', _IDENT))} AND {_within(_of(p), low, high)} AND {_once(_items(_of(p)))})"
_FIELDS = ("schema_version", "title", "question", "hypothesis", "experiment", "primary_metric", "direction", "timeout_seconds", "max_attempts", "limitations", "baseline")
_TEXTS = " AND ".join(_text(_of(k)) for k in ("title", "question", "hypothesis", "experiment", "primary_metric"))
_BOTH = [
    (_TEXTS, "texts must not be empty"), (f"{_string(_of('direction'))} IN ('maximize', 'minimize')", "direction is maximize or minimize"),
    (f"{_number(_of('timeout_seconds'))} > 0 AND {_number(_of('timeout_seconds'))} <= 86400", "timeout is within a day"), (_int(_of("max_attempts"), 1, 3), "one to three attempts"),
    (f"suffix({_string(_of('experiment'))}, '.py')", "the experiment is a Python script"),
]


def _told(guard: str, rules: list[tuple[str, str]]) -> str:
    quoted = lambda m: m.replace("'", "''")
    cases = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{quoted(m)}' END" for ok, m in rules)
    return f"CASE WHEN doc IS NULL THEN 'no document' WHEN NOT coalesce({guard}, false) THEN 'fields differ from the schema' ELSE array_to_string(list_filter([{cases}], lambda m: m IS NOT NULL), '; ') END"


def _twin(source: str, key: str, text: str, told: str, grouped: bool = True, more: str = "") -> str:
    group = f" GROUP BY {key}" if grouped else ""
    return f"SELECT id, {told} AS errors FROM (SELECT {key} AS id, CAST({text} AS JSON) AS doc{more} FROM {source}{group})"


def _twin_of_reviews() -> str:
    body = r"regexp_replace(regexp_replace(reply, '^\s+', ''), '\s+$', '')"
    inside = f"CASE WHEN starts_with({body}, '```json') AND ends_with({body}, '```') THEN substr({body}, 8, length({body}) - 10) WHEN starts_with({body}, '```') AND ends_with({body}, '```') THEN substr({body}, 4, length({body}) - 6) ELSE {body} END"
    return f"""SELECT conv_id * 1000 + turn AS id, conv_id, turn, CASE WHEN json_valid({inside}) THEN CAST({inside} AS JSON) END AS doc
  FROM (SELECT *, {_review(DUCK)} AS reply FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"""


def _rules() -> dict[str, tuple[str, list[tuple[str, str]]]]:
    reference = f"{_keys('x', 'title', 'url', 'note')} AND {_type(_of('title', 'x'), 'VARCHAR')} AND {_type(_of('note', 'x'), 'VARCHAR')} AND {_matches(_of('url', 'x'), _WEB)}"
    source = f"{_keys('x', 'id', 'title', 'url', 'local_file', 'note')} AND {_matches(_of('id', 'x'), _IDENT)} AND {_text(_of('title', 'x'))} AND {_text(_of('local_file', 'x'))} AND {_text(_of('note', 'x'))} AND ({_string(_of('url', 'x'))} = '' OR {_matches(_of('url', 'x'), _WEB)})"
    comment = f"{_keys('x', 'id', 'severity', 'comment', 'action')} AND " + " AND ".join(_text(_of(k, "x")) for k in ("id", "severity", "comment", "action"))
    lists = ("boundaries", "acceptance_checks", "context_files", "evidence_ids")
    baseline, trials = _string(_of("baseline")), f"len({_items(_of('candidates'))})"
    issues = _items(_of("issues"))
    routes = "list_transform(json_keys(doc, '$.models'), lambda k: json_extract(doc, '$.models.\"' || k || '\"'))"
    counts = ("token_budget", "input_token_reservation", "max_input_bytes", "max_output_tokens", "timeout_seconds", "max_attempts")
    stages, sid = _items(_of("stages")), _string(_of("id", "x"))
    at = f"list_transform({stages}, lambda x, i: struct_pack(s := x, ids := list_transform({stages}[1:i-1], lambda y: (y->>'$.id'))))"
    staged = lambda rule: f"(len(list_filter({at}, lambda p: NOT coalesce({rule}, false))) = 0)"
    s = lambda k: f"json_extract(p.s, '$.{k}')"
    needs = f"list_transform(coalesce(json_extract(p.s, '$.needs[*]'), []), lambda y: (y->>'$'))"  # noqa: F541
    gates = f"list_transform(list_filter({stages}, lambda y: (y->>'$.role') = 'freeze' AND (y->>'$.review') = 'true'), lambda y: (y->>'$.id'))"
    tainted = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({stages}, lambda y: [(y->>'$.id'), (y->>'$.split'), (y->>'$.needs[0]')])), lambda a, b: CASE WHEN b[2] = 'holdout' OR coalesce(list_contains(a, b[3]), false) THEN list_append(a, b[1]) ELSE a END)"
    return {
        "check_plans": (_keys("doc", *_FIELDS, "methods", "seeds", "references"), [
            (_int(_of("schema_version"), 1, 1), "unknown version"), *_BOTH, (_IDS("methods", 2, 10), "two to ten distinct methods"), (f"list_contains({_strings(_of('methods'))}, {baseline})", "baseline is a method"),
            (_SEEDS("seeds"), "two to thirty distinct seeds"), (f"{_every(_of('limitations'), _type('x', 'VARCHAR'))} AND len({_items(_of('limitations'))}) > 0", "limitations are needed"),
            (_every(_of("references"), reference), "references have a title, a web address and a note"),
        ]),
        "check_campaigns": (f"{_keys('doc', *_FIELDS, 'candidates', 'ablations', 'development_seeds', 'holdout_seeds', 'budget', 'search', 'sources')} AND {_int(_of('schema_version'), 2, 2)}", [
            *_BOTH, (_matches(_of("baseline"), _IDENT), "baseline is an identifier"), (_IDS("candidates", 1, 20), "one to twenty distinct candidates"), (_IDS("ablations", 1, 8), "one to eight distinct ablations"),
            (f"NOT list_contains(list_concat({_strings(_of('candidates'))}, {_strings(_of('ablations'))}), {baseline})", "baseline is neither candidate nor ablation"),
            (f"NOT list_has_any({_strings(_of('candidates'))}, {_strings(_of('ablations'))})", "a candidate is no ablation"), (f"{_SEEDS('development_seeds')} AND {_SEEDS('holdout_seeds')}", "two to thirty distinct seeds"),
            (f"NOT list_has_any({_items(_of('development_seeds'))}, {_items(_of('holdout_seeds'))})", "no seed is in both splits"),
            (f"{_keys(_of('budget'), 'max_attempts', 'max_timeout_seconds')} AND {_int(_of('budget.max_attempts'), 1)} AND {_number(_of('budget.max_timeout_seconds'))} >= {_number(_of('timeout_seconds'))}", "the budget admits no attempt"),
            (f"{_keys(_of('search'), 'max_trials', 'patience', 'min_improvement')} AND {_int(_of('search.max_trials'), 1, trials)} AND {_int(_of('search.patience'), 1, trials)} AND {_number(_of('search.min_improvement'))} >= 0", "search out of range"),
            (f"{_every(_of('limitations'), _text('x'))} AND len({_items(_of('limitations'))}) > 0", "limitations are needed"),
            (f"{_every(_of('sources'), source)} AND {_once('list_transform(' + _items(_of('sources')) + ', lambda x: ' + _string(_of('id', 'x')) + ')')}", "sources have an id of their own, texts and a web address"),
        ]),
        "check_assignments": (f"{_keys('doc', 'schema_version', 'max_output_tokens', 'task_id', 'model_alias', 'research_question', 'objective', *lists)} AND {_int(_of('schema_version'), 1, 1)}", [
            (" AND ".join(_text(_of(k)) for k in ("task_id", "model_alias", "research_question", "objective")), "a text is empty"), (" AND ".join(_every(_of(k), _text("x")) for k in lists), "a list holds something else than texts"),
            (f"len({_items(_of('boundaries'))}) > 0 AND len({_items(_of('acceptance_checks'))}) > 0", "boundaries and checks are needed"), (_int(_of("max_output_tokens"), 1), "output limit out of range"),
        ]),
        "check_feedback": (_keys("doc", "reviewer", "comments"), [
            (_text(_of("reviewer")), "reviewer is empty"), (f"len({_items(_of('comments'))}) > 0", "no comments"), (_all(_items(_of("comments")), comment), "comment out of schema"),
            (_once("list_transform(" + _items(_of("comments")) + ", lambda x: " + _string(_of("id", "x")) + ")"), "repeated id"), (_all(_items(_of("comments")), f"{_string(_of('severity', 'x'))} IN ('major', 'minor', 'question')"), "unknown severity"),
        ]),
        "check_results": (_type("doc", "OBJECT"), [
            (f"{_string(_of('method'))} = wanted AND {_int(_of('seed'), 'id', 'id')}", "identity differs"), (f"{_type(_of('metrics'), 'OBJECT')} AND list_contains(json_keys({_of('metrics')}), 'price')", "the primary metric is missing"),
            (_all("list_transform(json_keys(doc, '$.metrics'), lambda k: json_extract(doc, '$.metrics.' || k))", f"{_number('x')} IS NOT NULL"), "metrics are finite numbers"), (_type(_of("provenance"), "OBJECT"), "no provenance"),
        ]),
        "check_proposals": (_type("doc", "OBJECT"), [
            (" AND ".join(_text(_of(k)) for k in ("hypothesis", "parent", "falsifier", "expected_effect")), "a text is missing"), (f"len({_items(_of('evidence_refs'))}) > 0 AND len(json_keys(doc, '$.changes')) > 0", "evidence and a change are needed"),
            (_all(_items(_of("evidence_refs")), f"{_string('x')} IN ('F', 'O')"), "unknown evidence"),
        ]),
        "check_reviews": (_keys("doc", "summary", "strengths", "issues", "next_experiments"), [
            (_text(_of("summary")), "summary is empty"), (f"{_every(_of('strengths'), _type('x', 'VARCHAR'))} AND {_every(_of('next_experiments'), _type('x', 'VARCHAR'))}", "a list holds something else than texts"),
            (_every(_of("issues"), _keys("x", "severity", "evidence_ids", "problem", "action")), "issue out of schema"), (_all(issues, f"{_string(_of('severity', 'x'))} IN ('major', 'minor', 'question')"), "unknown severity"),
            (_all(issues, f"len(list_filter({_strings(_of('evidence_ids', 'x'))}, lambda e: e NOT IN ('1', '3', '5') AND e <> CAST(conv_id AS VARCHAR))) = 0"), "unknown evidence"), (_all(issues, f"{_text(_of('problem', 'x'))} AND {_text(_of('action', 'x'))}"), "an issue's text is empty"),
        ]),
        "check_routes": (f"{_int(_of('schema_version'), 1, 1)} AND {_type(_of('models'), 'OBJECT')} AND len(json_keys(doc, '$.models')) > 0", [
            (_all(routes, " AND ".join(_text(_of(k, "x")) for k in ("model", "api_key_env", "base_url"))), "a route lacks a field"), (_all(routes, _matches(_of("base_url", "x"), "https?://[^/?#@]+(/[^?#]*)?")), "a base URL is no plain web address"),
            (_all(routes, f"{_string(_of('api_format', 'x'))} IN ('chat', 'responses')"), "unknown API format"), (_all(routes, f"{_of('stream', 'x')} IS NULL OR {_type(_of('stream', 'x'), 'BOOLEAN')}"), "stream is true or false"),
            (_all(routes, f"{_of('api_key_env_aliases', 'x')} IS NULL OR {_every(_of('api_key_env_aliases', 'x'), _text('z'), 'z')}"), "aliases of keys are names"), (_all(routes, " AND ".join(_int(_of(k, "x"), 1) for k in counts)), "a limit is no positive whole number"),
            (_all(routes, f"{_number(_of('max_attempts', 'x'))} <= 3 AND {_number(_of('timeout_seconds', 'x'))} <= 1800"), "at most three attempts of 1800 seconds"), (_all(routes, f"{_number(_of('input_token_reservation', 'x'))} >= {_number(_of('max_input_bytes', 'x'))}"), "reservation below the input's bytes"),
            ("list_contains(json_keys(doc, '$.models'), doc->>'$.roles.reader')", "a role has an unknown alias"),
        ]),
        "check_receipts": (_type("doc", "OBJECT"), [
            (f"json_type(doc, '$.submission_confirmed') = 'BOOLEAN' AND {_string(_of('submission_confirmed'))} = 'true'", "not confirmed"), (f"rtrim({_string(_of('destination'))}, '/') = 'https://paperreview.ai'", "unexpected destination"),
            (f"{_string(_of('venue'))} = 'ICLR'", "unexpected venue"), ("NOT starts_with(token, 'sk-')", "no valid token"), (f"{_string(_of('paper_sha256'))} = paper", "another paper"), (f"{_string(_of('token_sha256'))} = sha256(token)", "another token"),
            (f"regexp_matches({_string(_of('submitted_at'))}, '(Z|[+-][0-9:]+)$') AND TRY_CAST({_string(_of('submitted_at'))} AS TIMESTAMPTZ) IS NOT NULL AND length({_string(_of('submitted_at'))}) > 19", "time has no zone"), (f"{_string(_of('review_status'))} IN ('pending', 'completed', 'failed')", "unknown status"),
        ]),
        "check_projects": (f"{_int(_of('schema_version'), 5, 5)} AND len({stages}) > 0 AND {_all(stages, _type('x', 'OBJECT'))}", [
            (f"{_matches(_of('id'), '[a-zA-Z0-9_-]+')} AND {_text(_of('question'))}", "id or question is wrong"), (f"{_of('model_token_limit')} IS NULL OR {_int(_of('model_token_limit'), 0)}", "token limit of the project is wrong"),
            (f"{_all(stages, _matches(_of('id', 'x'), '[a-zA-Z0-9_-]+'))} AND {_once('list_transform(' + stages + ', lambda x: ' + sid + ')')}", "bad or repeated stage id"), (_all(stages, f"{_string(_of('adapter', 'x'))} IN ({', '.join(repr(a) for a in C.ADAPTERS)})"), "unknown adapter"),
            (staged(f"{_type(s('needs'), 'ARRAY')} AND {_once(needs)} AND list_has_all(p.ids, {needs})"), "needs must be unique and stand before"), (_all(stages, _type(_of("review", "x"), "BOOLEAN")), "review is true or false"),
            (_all(stages, f"coalesce({_string(_of('role', 'x'))} NOT IN ('proposal', 'freeze', 'interpretation'), true) OR {_string(_of('review', 'x'))} = 'true'"), "decisions are reviewed"), (_all(stages, _int(_of("max_attempts", "x"), 1)), "attempts of a stage are wrong"),
            (_all(stages, f"{_string(_of('split', 'x'))} IN ('development', 'holdout')"), "unknown split"), (staged(f"{_string(s('split'))} <> 'holdout' OR list_has_any({needs}, {gates})"), "a holdout needs a reviewed freeze"),
            (staged(f"coalesce({_string(s('role'))} NOT IN ('proposal', 'literature'), true) OR NOT list_has_any({needs}, {tainted})"), "a proposal rests on a holdout"),
            (_all(stages, f"{_int(_of('token_limit', 'x'), 0)} AND ({_string(_of('adapter', 'x'))} <> 'native_tasks' OR {_int(_of('token_limit', 'x'), 1)})"), "paid stages need a token limit"), ("true", "a result's schema is no schema"),
        ]),
    }


def queries() -> dict:
    named = (check_plans, check_campaigns, campaign_reserves, check_assignments, check_feedback, check_results, check_reviews, review_issues, reply_objects, response_texts, check_routes, check_receipts, check_projects, check_proposals)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    told = {name: _told(*rules) for name, rules in _rules().items()}
    n = lambda k: f"len(json_extract(doc, '$.{k}[*]'))"
    needed = f"CAST((2 * {n('development_seeds')} + (2 + {n('ablations')}) * {n('holdout_seeds')}) * CAST(doc->>'$.max_attempts' AS BIGINT) AS BIGINT)"
    reviews = _twin_of_reviews()
    orders = "(SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)"
    wanted = f", CASE WHEN o_totalprice > 440000 THEN 'low' ELSE {_PRIORITY} END AS wanted"
    bound = ", sha256(CASE WHEN o_totalprice > 420000 THEN 'changed' ELSE '' || o_orderkey END) AS paper, CASE WHEN o_custkey % 50 = 0 THEN 'sk-' ELSE 'token' END || o_custkey AS token"
    return {
        "check_plans": _twin("orders", "o_custkey", _plan(DUCK), told["check_plans"]),
        "check_campaigns": _twin("orders", "o_custkey", _campaign(DUCK), told["check_campaigns"]),
        "campaign_reserves": f"SELECT id, {needed} AS needed, CAST(doc->>'$.budget.max_attempts' AS BIGINT) >= {needed} AS admitted FROM (SELECT o_custkey AS id, CAST({_campaign(DUCK)} AS JSON) AS doc FROM orders GROUP BY o_custkey)",
        "check_assignments": _twin("conversations", "conv_id", _assignment(DUCK), told["check_assignments"]),
        "check_feedback": _twin("conversations", "conv_id", _feedback(DUCK), told["check_feedback"]),
        "check_results": _twin("orders", "o_orderkey", _result(DUCK), told["check_results"], False, wanted),
        "check_proposals": f"""SELECT id, CASE WHEN errors = '' AND row_number() OVER (PARTITION BY errors, doc->>'$.parent', CAST(doc->'$.changes' AS VARCHAR) ORDER BY id) > 1 THEN 'duplicate candidate' ELSE errors END AS errors
  FROM (SELECT id, doc, {told['check_proposals']} AS errors FROM (SELECT o_custkey AS id, CAST({_proposal(DUCK)} AS JSON) AS doc FROM orders GROUP BY o_custkey))""",
        "check_reviews": f"SELECT id, {told['check_reviews']} AS errors FROM ({reviews})",
        "review_issues": f"WITH r AS (SELECT doc, {told['check_reviews']} AS errors FROM ({reviews})) SELECT state, count(*) AS n FROM (SELECT unnest(json_extract(doc, '$.issues[*]'))->>'$.severity' AS state FROM r WHERE errors = '' UNION ALL SELECT 'quarantine' FROM r WHERE errors <> '') GROUP BY state",
        "reply_objects": f"SELECT id, doc IS NOT NULL AND turn % 4 <> 2 AS object, CASE WHEN turn % 4 <> 2 THEN doc->>'$.summary' END AS summary FROM ({reviews})",
        "response_texts": f"""SELECT id, coalesce(doc->>'$.output_text', array_to_string(list_transform(list_filter(flatten(list_transform(list_filter(json_extract(doc, '$.output[*]'), lambda i: (i->>'$.type') = 'message'),
  lambda i: json_extract(i, '$.content[*]'))), lambda p: (p->>'$.type') = 'output_text'), lambda p: (p->>'$.text')), '')) AS text FROM (SELECT conv_id AS id, CAST({_responses(DUCK)} AS JSON) AS doc FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)""",
        "check_routes": _twin("supplier", "s_suppkey", _models(DUCK), told["check_routes"], False),
        "check_receipts": _twin("orders", "o_orderkey", _receipt(DUCK), told["check_receipts"], False, bound),
        "check_projects": _twin(orders, "o_custkey", _project(DUCK), told["check_projects"]),
    }

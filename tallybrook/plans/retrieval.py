"""Queries over conversations: retrieval, packing, evaluation; and their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import packing as P
from ..operators import retrieval as R
from ..sources import tables as S
from ..sources.shared import cut

#: The invented prose has few of the real cues, so registered queries take some frequent words as cues beside them.
CUES = (*T.CHANGE_CUES, "the", "that", "and", "les", "der", "que")
#: Units and strategies of the study.
METHODS = (
    "turn_bm25", "turn_timecue", "turn_rrf", "turn_density", "turn_stop",
    "sentence_bm25", "sentence_timecue", "sentence_rrf", "sentence_density",
)
ALPHAS, BETAS = (0.0, 0.1, 0.25, 0.5, 0.75), (0.0, 0.1, 0.25)


def _docs(spark, d, unit="turn") -> DataFrame:
    return R.documents(S.turns(spark, d), unit, CUES)


def _scores(spark, d, unit="turn") -> DataFrame:
    return R.scores(_docs(spark, d, unit), S.queries(spark, d))


class _Study:
    """What the queries over conversations share, each written once when it is first asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """rows dealt out by keys, over a number of parts that is given, as the work on a row is more than its bytes tell."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *keys)

    @cached_property
    def turns(self) -> DataFrame:
        return cut(S.turns(self.spark, self.d))

    @cached_property
    def asked(self) -> DataFrame:
        return cut(S.queries(self.spark, self.d, self.turns))

    @cached_property
    def gold(self) -> DataFrame:
        return cut(S.gold(self.turns))

    @cached_property
    def odd(self) -> bool:
        """Whether any text needs Python to be normalised; contexts are made of these texts and plain marks."""
        return not self.turns.filter(~T.is_plain(F.col("text"))).isEmpty()

    def scored(self, unit: str) -> DataFrame:
        return cut(R.scores(cut(R.documents(self.turns, unit, CUES)), self.asked))


def eval_rows(spark: SparkSession, d: str, methods=METHODS, budgets=P.BUDGETS) -> DataFrame:
    """One row for each scenario, query, method and budget. Documents of both units are scored and ranked in one pass, over
    tables that are written once."""
    study = _Study(spark, d)
    units = {u: tuple(m.split("_", 1)[1] for m in methods if m.startswith(u)) for u in ("turn", "sentence")}
    keys, greedy = ("uid", "dim", "method"), None
    method = F.concat_ws("_", "unit", "strategy")
    for unit, strategies in units.items():
        if strategies:
            r = R.ranked_all(study.scored(unit), strategies).withColumn("unit", F.lit(unit)).withColumn("method", method)
            greedy = r if greedy is None else greedy.unionByName(r)
    packed = P.pack_greedy(study.dealt(greedy.filter("strategy <> 'stop'"), *keys), budgets, keys)
    if "stop" in units["turn"]:
        packed = packed.unionByName(P.pack_stop(greedy.filter("strategy = 'stop'"), budgets, keys))
    return P.score(packed, study.gold, study.odd)


def audit(spark: SparkSession, d: str) -> DataFrame:
    t = S.turns(spark, d)
    key = F.struct("session", "turn", "text")
    joined = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, key))), lambda x: x["text"]), " ")
    text = t.groupBy("uid").agg(joined("user").alias("user"), joined("assistant").alias("assistant"), F.count_distinct("session").alias("n_sessions"), F.min("session").alias("first_session"))
    sizes = _docs(spark, d).groupBy("uid").agg(F.count("*").alias("turn_count"), F.median("bytes").alias("median_turn_bytes"))
    j = text.join(S.gold(t), "uid").join(sizes, "uid")
    user, assistant = T.includes(F.col("user"), F.col("m_new")), T.includes(F.col("assistant"), F.col("m_new"))
    flag = lambda c: c.cast("int")
    return j.select(
        "uid", "type", flag(user).alias("user_exact"), flag(assistant).alias("assistant_exact"), flag(~user & assistant).alias("assistant_only"),
        flag(T.includes_tokens(F.col("user"), F.col("m_new"))).alias("user_token"), F.octet_length("user").cast("long").alias("history_bytes"), "turn_count", "median_turn_bytes",
        ((F.col("update_session") - F.col("first_session")) / F.greatest(F.lit(1), F.col("n_sessions") - 1)).alias("update_fraction"),
    )


def sensitivity_rows(spark, d) -> DataFrame:
    study = _Study(spark, d)
    scored = study.scored("turn")
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in ALPHAS for b in BETAS)))
    by = ("uid", "dim", "alpha", "beta")
    from pyspark.sql import Window

    most = F.max("score").over(Window.partitionBy("uid", "dim"))
    s = scored.withColumn("rel", F.col("score") / F.when(most == 0, F.lit(1.0)).otherwise(most)).withColumn("g", grid).select("*", "g.alpha", "g.beta")
    value = F.round(F.col("rel") + F.col("alpha") * F.col("recency") + F.col("beta") * F.col("cue"), 12)
    ranked = s.withColumn("value", value).withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), F.desc("doc_i"))))
    out = P.score(P.pack_greedy(study.dealt(ranked, *by), (4096,), by), study.gold, study.odd)
    return out.select("uid", "dim", "alpha", "beta", "new")


def reader_rows(spark, d) -> DataFrame:
    """Arms, models and grades; grades come from a hash, as no model answers here."""
    rows = eval_rows(spark, d, ("turn_bm25", "sentence_bm25"), (4096,)).filter("dim = 'frequent'").select("uid", F.col("method").alias("arm"), "new")
    more = rows.filter("arm = 'turn_bm25'").withColumn("arm", F.explode(F.array(F.lit("oracle_update"), F.lit("oracle_sham"))))
    rows = rows.unionByName(more).withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
    rows = rows.withColumn("id", F.concat_ws(":", F.col("uid").cast("string"), "arm", "model"))
    h = lambda s: F.substring(F.md5(F.concat(F.lit(s), F.col("id"))), 1, 1)
    graded = h("graded") < "c"
    return rows.select("*", (h("answered") < "e").alias("answered"), graded.alias("graded"), F.when(graded, h("pass") < "8").alias("pass"))


# ---------------------------------------------------------------- queries
def user_turns(spark, d):
    return _docs(spark, d).select("uid", "session", "turn", "rank", "doc_i", "text", "serialized", "bytes", F.round("recency", 9).alias("recency"), "cue")


def sentences(spark, d):
    return _docs(spark, d, "sentence").select("uid", "session", "turn", "part", "rank", "doc_i", "text", "serialized", "bytes")


def nested_unnest(spark, d):
    return S.unnest(S.scenarios(spark, d)).filter("role = 'user'").select("uid", "session", "ti", "role", F.octet_length("text").alias("bytes"))


def token_counts(spark, d):
    return R.term_counts(_docs(spark, d))


def doc_stats(spark, d):
    return R.lengths(_docs(spark, d)).withColumn("avg_length", F.round("avg_length", 9))


def doc_freq(spark, d):
    return R.document_frequency(R.term_counts(_docs(spark, d)))


def bm25_scores(spark, d):
    return _scores(spark, d).select("uid", "dim", "doc_i", F.round("score", 9).alias("score"))


def _rank(strategy, unit="turn"):
    def run(spark, d):
        return R.ranked(_scores(spark, d, unit), strategy).select("uid", "dim", "doc_i", "rn")

    return run


def rank_policy(spark, d):
    policies = spark.createDataFrame(R.POLICIES, R.POLICY_SCHEMA)
    return R.ranked_by_policy(_scores(spark, d), policies).select("uid", "dim", "policy", "doc_i", "rn")


def policy_faults(spark, d):
    """Policies drawn up from the parts table, some of them unfit."""
    p = S.table(spark, d, "part")
    third = (F.col("p_size") - 25) / 20
    weight = F.when(F.col("p_partkey") % 5 > 0, F.round(third, 4)).otherwise(F.lit(0.0))
    named = p.select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("name"), weight.alias("relevance"), F.lit(0.0).alias("recency"), F.when(F.col("p_partkey") % 7 > 0, F.lit(0.0)).alias("change"))
    return R.policy_faults(named).select("name", F.array_join("faults", ",").alias("faults"))


def _packed(p: DataFrame) -> DataFrame:
    return p.select("uid", "dim", "budget", F.array_join(F.col("selected").cast("array<string>"), ",").alias("selected"), "bytes", F.sha2("context", 256).alias("context_sha256"), F.array_join(F.col("sessions").cast("array<string>"), ",").alias("sessions"))


def pack_stop(spark, d):
    return _packed(P.pack_stop(R.ranked(_scores(spark, d), "stop")))


def pack_greedy(spark, d):
    return _packed(P.pack_greedy(R.ranked(_scores(spark, d), "bm25")))


def pack_exclude(spark, d):
    ranked = R.ranked(_scores(spark, d), "bm25")
    hits = _docs(spark, d).join(S.gold(S.turns(spark, d)), "uid").filter(T.includes(F.col("text"), F.col("m_new"))).select("uid", "doc_i")
    return _packed(P.pack_excluding(ranked, hits, (3072,)))


def context_score(spark, d):
    return eval_rows(spark, d)


def dataset_audit(spark, d):
    return audit(spark, d)


def eval_summary(spark, d):
    out = E.two_level(eval_rows(spark, d))
    return out.select("method", "budget", "n", *(F.round(m, 9).alias(m) for m in E.METRICS))


def joint_states(spark, d):
    return E.joint_states(eval_rows(spark, d)).withColumn("mean", F.round("mean", 9))


def paired_contrast(spark, d):
    return E.contrast(eval_rows(spark, d)).withColumn("mean", F.round("mean", 9))


def sensitivity(spark, d):
    return E.two_level(sensitivity_rows(spark, d), ("alpha", "beta"), ("new",)).withColumn("new", F.round("new", 9))


def strata(spark, d):
    return E.strata(eval_rows(spark, d, ("turn_bm25", "sentence_bm25"), (4096,)), audit(spark, d)).select("field", F.round("cut", 9).alias("cut"), "side", "n", F.round("mean", 9).alias("mean"))


def ceiling(spark, d):
    return audit(spark, d).agg(*(F.sum(c).alias(c) for c in ("user_exact", "assistant_exact", "assistant_only", "user_token")))


def _subject_new(spark, d):
    return E.per_subject(eval_rows(spark, d), ("method", "budget"), ("new",))


def _rounded(intervals):
    return intervals.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in intervals.dtypes))


def bootstrap_ci(spark, d):
    return _rounded(E.weighted_intervals(_subject_new(spark, d), ("method", "budget"), ("new",))).select("method", "budget", "n", "low", "high")


def bootstrap_ci_order_stat(spark, d):
    return _rounded(E.weighted_order(_subject_new(spark, d), ("method", "budget"), "new"))


def intervals(spark, d):
    """95 % intervals by method and budget of all metrics, the joint states and the contrast."""
    metrics = (*E.METRICS, *(s[0] for s in E.STATES), "paired")
    found = E.weighted_intervals(E.per_subject_all(eval_rows(spark, d)), ("method", "budget"), metrics)
    return _rounded(found).filter("NOT (metric = 'paired' AND method = 'turn_bm25')")


def sensitivity_intervals(spark, d):
    return _rounded(E.weighted_intervals(E.per_subject(sensitivity_rows(spark, d), ("alpha", "beta"), ("new",)), ("alpha", "beta"), ("new",)))


def strata_intervals(spark, d):
    """95 % intervals on both sides of each field's median."""
    values = E.strata_values(eval_rows(spark, d, ("turn_bm25", "sentence_bm25"), (4096,)), audit(spark, d))
    return _rounded(E.weighted_intervals(values, ("field", "side"), ("diff",)))


def reader_intervals(spark, d):
    """95 % intervals of graded responses by reader and arm."""
    values = reader_rows(spark, d).filter("graded").select("model", "arm", "uid", F.col("pass").cast("double").alias("pass"))
    return _rounded(E.weighted_intervals(values, ("model", "arm"), ("pass",)))


def reader_summary(spark, d):
    return E.reader_summary(reader_rows(spark, d))


def missing_bounds(spark, d):
    return E.missing_bounds(reader_rows(spark, d))


def association(spark, d):
    return E.association(reader_rows(spark, d))


def blind_labels(spark, d):
    """Responses in a stable hidden order; graded by the other model."""
    from pyspark.sql import Window

    rows = reader_rows(spark, d).filter("answered")
    by = Window.partitionBy("uid", "model").orderBy(F.sha2(F.concat(F.lit("blind:"), "id"), 256))
    label = F.concat(F.lit("response_"), F.row_number().over(by).cast("string"))
    return rows.select("uid", "model", F.when(F.col("model") == "m1", "m2").otherwise("m1").alias("judge"), label.alias("label"), "id")


def reader_arms(spark, d):
    """Natural arms, and equal-byte pairs: the last turn with the new statement, or padding of its size."""
    gold = S.gold(S.turns(spark, d))
    q = S.queries(spark, d).filter("dim = 'frequent'")
    docs = cut(_docs(spark, d))
    ranked = cut(R.ranked(R.scores(docs, q), "bm25"))
    natural = P.pack_greedy(ranked, (4096,)).select("uid", F.lit("turn_bm25").alias("arm"), "context")
    s = P.pack_greedy(R.ranked(R.scores(_docs(spark, d, "sentence"), q), "bm25"), (4096,)).select("uid", F.lit("sentence_bm25").alias("arm"), "context")
    hits = docs.join(gold, "uid").filter(T.includes(F.col("text"), F.col("m_new")))
    last = hits.groupBy("uid").agg(F.max_by("serialized", "doc_i").alias("update"), F.max_by("bytes", "doc_i").alias("size")).filter("size <= 1024")
    base = P.pack_excluding(ranked, hits.select("uid", "doc_i"), (3072,)).join(last, "uid")
    filler = "[withheld evidence] "  # fixed value
    sham = F.concat(F.lit(filler), F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col("size") - len(filler))))
    arms = F.explode(F.array(F.struct(F.lit("oracle_update").alias("arm"), F.concat("context", "update").alias("c")), F.struct(F.lit("oracle_sham").alias("arm"), F.concat("context", sham).alias("c"))))
    made = base.select("uid", arms.alias("a")).select("uid", "a.arm", F.col("a.c").alias("context"))
    return natural.unionByName(s).unionByName(made).select("uid", "arm", F.octet_length("context").alias("bytes"), F.sha2("context", 256).alias("context_sha256"))


# ---------------------------------------------------------------- SQL
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}))"


def _norm(c: str) -> str:
    """For plain text; its engine has no compatibility composition, and the tables hold no text that needs it."""
    return rf"replace(lower(trim(regexp_replace({c}, '{T.BLANK}+', ' ', 'g'))), 'ß', 'ss')"


def _has(hay: str, needle: str) -> str:
    return f"contains({_norm(hay)}, {_norm(needle)})"


def _words(c: str) -> str:
    return rf"regexp_extract_all({_norm(c)}, '[\p{{L}}\p{{N}}_]+')"


def _has_tokens(hay: str, needle: str) -> str:
    return f"(contains(' ' || array_to_string({_words(hay)}, ' ') || ' ', ' ' || array_to_string({_words(needle)}, ' ') || ' ') AND len({_words(needle)}) > 0)"


def _sent(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '([.!?]){T.BLANK}+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^{T.BLANK}+|{T.BLANK}+$', '', 'g')), lambda s: s <> '')"


# its engine's word boundaries see ASCII only
_CUE = rf"(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(CUES)})([^\p{{L}}\p{{N}}_]|$)"
_TURNS = f"""
turns AS (SELECT conv_id // 10 AS uid, conv_id AS session, turn, role, text FROM conversations),
users AS (SELECT uid, session, turn, text, CAST(row_number() OVER w - 1 AS INT) AS rank, count(*) OVER (PARTITION BY uid) AS n_turns
          FROM turns WHERE role = 'user' WINDOW w AS (PARTITION BY uid ORDER BY session, turn)),
turn_docs AS (SELECT uid, session, turn, 0 AS part, rank, n_turns, text, '[session ' || session || ', turn ' || turn || '] ' || text || chr(10) AS serialized FROM users),
sent_docs AS (SELECT uid, session, turn, CAST(part - 1 AS INT) AS part, rank, n_turns, s AS text,
              '[session ' || session || ', turn ' || turn || ', sentence ' || (part - 1) || '] ' || s || chr(10) AS serialized
              FROM (SELECT *, unnest(parts) AS s, generate_subscripts(parts, 1) AS part FROM (SELECT *, {_sent('text')} AS parts FROM users))),
docs AS (SELECT 'turn' AS unit, * FROM turn_docs UNION ALL SELECT 'sentence', * FROM sent_docs),
placed AS (SELECT *, CAST(strlen(serialized) AS INT) AS bytes, CAST(row_number() OVER (PARTITION BY unit, uid ORDER BY session, turn, part) - 1 AS INT) AS doc_i,
           rank / greatest(1, n_turns - 1)::DOUBLE AS recency, CAST(regexp_matches(text, '{_CUE}') AS INT) AS cue FROM docs)"""
_TERMS = f""", term_list AS (SELECT unit, uid, doc_i, unnest({_tok('text')}) AS term FROM placed),
terms AS (SELECT unit, uid, doc_i, term, count(*) AS tf FROM term_list GROUP BY ALL),
lens AS (SELECT unit, uid, doc_i, length, count(*) OVER w AS n_docs, avg(length) OVER w AS avg_length
         FROM (SELECT unit, uid, doc_i, CAST(len({_tok('text')}) AS BIGINT) AS length FROM placed) WINDOW w AS (PARTITION BY unit, uid))"""
_SCORES = _TERMS + f""", counted AS (SELECT uid, term, count(*) AS n FROM (SELECT uid, unnest({_tok('text')}) AS term FROM users) GROUP BY ALL),
top12 AS (SELECT uid, term, row_number() OVER (PARTITION BY uid ORDER BY n DESC, term) AS rn FROM counted QUALIFY rn <= 12),
qs AS (SELECT uid, 'frequent' AS dim, string_agg(term, ' ' ORDER BY rn) AS query FROM top12 GROUP BY uid
       UNION ALL SELECT u.uid, 'benchmark', b.text FROM (SELECT DISTINCT uid FROM users) u JOIN benchmark b ON u.uid % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id),
asked AS (SELECT DISTINCT uid, dim, unnest({_tok('query')}) AS term FROM qs),
hits AS (SELECT t.*, count(*) OVER (PARTITION BY unit, uid, term) AS df FROM terms t),
summed AS (SELECT h.unit, h.uid, a.dim, h.doc_i, (sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * ((1 - 0.75::DOUBLE) + 0.75::DOUBLE * length / greatest(1.0::DOUBLE, avg_length))))) AS score
           FROM hits h JOIN asked a USING (uid, term) JOIN lens l ON l.unit = h.unit AND l.uid = h.uid AND l.doc_i = h.doc_i GROUP BY ALL),
scored AS (SELECT p.*, q.dim, coalesce(s.score, 0) AS score FROM placed p JOIN qs q USING (uid) LEFT JOIN summed s ON s.unit = p.unit AND s.uid = p.uid AND s.doc_i = p.doc_i AND s.dim = q.dim),
rel AS (SELECT *, score / CASE WHEN max(score) OVER w = 0 THEN 1 ELSE max(score) OVER w END AS r, count(*) OVER w AS n_all FROM scored WINDOW w AS (PARTITION BY unit, uid, dim)),
both_ranks AS (SELECT *, row_number() OVER (PARTITION BY unit, uid, dim ORDER BY r DESC, doc_i DESC) AS lex, row_number() OVER (PARTITION BY unit, uid, dim ORDER BY recency DESC, doc_i DESC) AS rec FROM rel),
valued AS (SELECT * EXCLUDE (lex, rec), unnest([
   {{'strategy': 'bm25', 'v': r}}, {{'strategy': 'stop', 'v': r}}, {{'strategy': 'timecue', 'v': r + 0.25::DOUBLE * recency + 0.1::DOUBLE * cue}},
   {{'strategy': 'rrf', 'v': 1.0::DOUBLE / (60 + lex) + 1.0::DOUBLE / (60 + rec)}}, {{'strategy': 'density', 'v': r / greatest(1, bytes)}}]) AS x FROM both_ranks),
ranked AS (SELECT *, x.strategy AS strategy, CAST(row_number() OVER (PARTITION BY unit, uid, dim, x.strategy ORDER BY round(x.v, 12) DESC, doc_i DESC) AS INT) AS rn FROM valued)"""
_GOLD = f""", ends AS (SELECT uid, arg_min(text, (session, turn)) AS o, arg_max(text, (session, turn)) AS n, arg_max(session, (session, turn)) AS update_session FROM users GROUP BY uid),
gold AS (SELECT uid, 'T' || (uid % 2 + 1) AS type, coalesce({_sent('o')}[1], '') AS m_old, coalesce({_sent('n')}[1], '') AS m_new, update_session FROM ends)"""


def _packs(jobs: str, name: str = "packs") -> str:
    """jobs: a relation with job (any key), budget, rn, doc_i, bytes, session, serialized; greedy selection by recursion."""
    return f""", seq AS (SELECT *, row_number() OVER (PARTITION BY job, budget ORDER BY rn) AS k FROM ({jobs})),
fold AS (SELECT job, budget, CAST(0 AS BIGINT) AS k, 0 AS used, CAST([] AS INT[]) AS ids FROM (SELECT DISTINCT job, budget FROM seq)
  UNION ALL SELECT f.job, f.budget, s.k, CASE WHEN f.used + s.bytes <= f.budget THEN f.used + s.bytes ELSE f.used END,
    CASE WHEN f.used + s.bytes <= f.budget THEN list_append(f.ids, s.doc_i) ELSE f.ids END
  FROM fold f JOIN seq s ON s.job = f.job AND s.budget = f.budget AND s.k = f.k + 1),
done AS (SELECT job, budget, arg_max(ids, k) AS ids FROM fold GROUP BY job, budget),
{name} AS (SELECT d.job, d.budget, coalesce(list(s.doc_i ORDER BY s.doc_i) FILTER (s.doc_i IS NOT NULL), []) AS selected, coalesce(string_agg(s.serialized, '' ORDER BY s.doc_i), '') AS context,
  CAST(coalesce(sum(s.bytes), 0) AS INT) AS bytes, coalesce(list_sort(list(DISTINCT s.session) FILTER (s.session IS NOT NULL)), []) AS sessions
  FROM done d LEFT JOIN seq s ON s.job = d.job AND s.budget = d.budget AND list_contains(d.ids, s.doc_i) GROUP BY d.job, d.budget)"""


_BUDGETS = "unnest([1024, 2048, 4096, 8192, 16384])"


def _eval(where: str = "TRUE", budgets: str = _BUDGETS) -> str:
    jobs = f"SELECT {{'uid': uid, 'dim': dim, 'method': unit || '_' || strategy}} AS job, {budgets} AS budget, rn, doc_i, bytes, session, serialized FROM ranked WHERE strategy <> 'stop' AND ({where})"
    return (
        "WITH RECURSIVE" + _TURNS + _SCORES + _GOLD + _packs(jobs)
        + f""", stops AS (SELECT {{'uid': uid, 'dim': dim, 'method': 'turn_stop'}} AS job, budget, coalesce(string_agg(serialized, '' ORDER BY doc_i) FILTER (fits), '') AS context,
  CAST(coalesce(sum(bytes) FILTER (fits), 0) AS INT) AS bytes, coalesce(list(DISTINCT session) FILTER (fits), []) AS sessions
  FROM (SELECT *, total <= budget AS fits FROM (SELECT *, sum(bytes) OVER (PARTITION BY uid, dim ORDER BY rn) AS total, {budgets} AS budget FROM ranked WHERE unit = 'turn' AND strategy = 'stop' AND ({where}))) GROUP BY uid, dim, budget),
every AS (SELECT job, budget, context, bytes, sessions FROM packs UNION ALL SELECT * FROM stops),
evals AS (SELECT job.uid AS uid, job.dim AS dim, job.method AS method, budget, type, CAST({_has('context', 'm_new')} AS INT) AS "new", CAST({_has('context', 'm_old')} AS INT) AS "old",
  CAST({_has_tokens('context', 'm_new')} AS INT) AS token_new, CAST(list_contains(sessions, update_session) AS INT) AS update_session, bytes
  FROM every JOIN gold g ON g.uid = job.uid)"""
    )


_AUDIT = f""", joined AS (SELECT uid, coalesce(string_agg(text, ' ' ORDER BY session, turn) FILTER (role = 'user'), '') AS u, coalesce(string_agg(text, ' ' ORDER BY session, turn) FILTER (role = 'assistant'), '') AS a,
  count(DISTINCT session) AS n_sessions, min(session) AS first_session FROM turns GROUP BY uid),
audit AS (SELECT j.uid, type, CAST({_has('u', 'm_new')} AS INT) AS user_exact, CAST({_has('a', 'm_new')} AS INT) AS assistant_exact, CAST(NOT {_has('u', 'm_new')} AND {_has('a', 'm_new')} AS INT) AS assistant_only,
  CAST({_has_tokens('u', 'm_new')} AS INT) AS user_token, CAST(strlen(u) AS BIGINT) AS history_bytes, turn_count, median_turn_bytes,
  (update_session - first_session) / greatest(1, n_sessions - 1)::DOUBLE AS update_fraction
  FROM joined j JOIN gold USING (uid) JOIN (SELECT uid, count(*) AS turn_count, CAST(median(bytes) AS DOUBLE) AS median_turn_bytes FROM placed WHERE unit = 'turn' GROUP BY uid) USING (uid))"""
_MEANS = ", ".join(f'avg("{m}") AS "{m}"' for m in E.METRICS)
_ROUNDED = ", ".join(f'round(avg("{m}"), 9) AS "{m}"' for m in E.METRICS)
_PAIRED = """, sub AS (SELECT method, budget, uid, avg("new") AS "new" FROM evals GROUP BY ALL),
diffs AS (SELECT s.method, s.budget, s.uid, s."new" - b."new" AS diff FROM sub s JOIN sub b ON b.method = 'turn_bm25' AND b.budget = s.budget AND b.uid = s.uid WHERE s.method <> 'turn_bm25')"""
_READERS = """, native_arms AS (SELECT uid, method AS arm, "new" FROM evals WHERE dim = 'frequent' AND method <> 'turn_stop'),
arms AS (SELECT * FROM native_arms UNION ALL SELECT uid, unnest(['oracle_update', 'oracle_sham']), "new" FROM native_arms WHERE arm = 'turn_bm25'),
ids AS (SELECT *, uid || ':' || arm || ':' || model AS id FROM (SELECT *, unnest(['m1', 'm2']) AS model FROM arms)),
readers AS (SELECT *, left(md5('answered' || id), 1) < 'e' AS answered, left(md5('graded' || id), 1) < 'c' AS graded,
  CASE WHEN left(md5('graded' || id), 1) < 'c' THEN left(md5('pass' || id), 1) < '8' END AS pass FROM ids)"""
_READ_EVAL = _eval("strategy = 'bm25' AND dim = 'frequent'", "unnest([4096])") + _READERS
_SUBJECTS = ', subjects AS (SELECT method, budget, uid, avg("new") AS "new" FROM evals GROUP BY method, budget, uid)'
_ALL = f""", means AS (SELECT method, budget, uid, {_MEANS}, {", ".join(f'avg(CAST("old" = {o} AND "new" = {n} AS INT)) AS "{s}"' for s, o, n in E.STATES)} FROM evals GROUP BY ALL),
per AS (SELECT *, "new" - max("new") FILTER (method = 'turn_bm25') OVER (PARTITION BY budget, uid) AS paired FROM means)"""
_LIST = "array_to_string(selected, ',') AS selected, bytes, sha256(context) AS context_sha256, array_to_string(sessions, ',') AS sessions"


def weights_sql(source: str, keys: str, metrics: tuple[str, ...], repeats: int = 10_000, seed: int = 20260930) -> str:
    """Tables `bounds` (keys, metric, n, mean, low, high) and `orders_of` (keys, n, mean, all resampled means in order) of
    the source's members."""
    p, first = E.PRIME, metrics[0]
    fifth = lambda i: f"""x{i} AS (SELECT uid, b, CAST((CAST((s * s % {p}) * (s * s % {p}) % {p} AS BIGINT) * s) % {p} AS BIGINT) AS x, (k * 69621 + 1) % {p} AS k FROM (SELECT uid, b, k, (x + k) % {p} AS s FROM x{i - 1}))"""
    weight = "CASE " + " ".join(f"WHEN x < {r} THEN {k}" for k, r in enumerate(E.RISES)) + f" ELSE {len(E.RISES)} END"
    whole = " AND ".join(f"{m} IS NOT NULL" for m in metrics)
    listed = lambda make: "[" + ", ".join(make(m, m.strip('"')) for m in metrics) + "]"
    same = " AND ".join(f"m.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f""", members AS (SELECT * FROM {source} WHERE {whole}),
x0 AS (SELECT uid, CAST(b AS BIGINT) AS b, CAST('0x' || substr(md5(CAST(uid AS VARCHAR)), 1, 8) AS BIGINT) % {p} AS x, ((b + 1) * 48271 + {seed}) % {p} AS k FROM (SELECT DISTINCT uid FROM members), range({repeats}) AS t(b)),
{fifth(1)}, {fifth(2)}, {fifth(3)}, weighed AS (SELECT uid, b, {weight} AS w FROM x3),
resampled AS (SELECT {", ".join("m." + k.strip() for k in keys.split(","))}, b, {", ".join(f"sum(w * m.{m}) / sum(w) AS {m}" for m in metrics)} FROM members m JOIN weighed v ON v.uid = m.uid WHERE w > 0 GROUP BY ALL),
long_m AS (SELECT {keys}, unnest({listed(lambda m, n: f"{{'metric': '{n}', 'x': {m}}}")}) AS s FROM resampled),
cut_m AS (SELECT {keys}, s.metric AS metric, round(quantile_cont(s.x, 0.025), 9) AS low, round(quantile_cont(s.x, 0.975), 9) AS high FROM long_m GROUP BY ALL),
seen AS (SELECT {keys}, unnest({listed(lambda m, n: f"{{'metric': '{n}', 'mean': round(avg({m}) FILTER ({whole}), 9)}}")}) AS s, count(*) FILTER ({whole}) AS n FROM {source} GROUP BY {keys}),
bounds AS (SELECT {", ".join("m." + k.strip() for k in keys.split(","))}, m.s.metric AS metric, n, m.s.mean AS mean, low, high FROM seen m LEFT JOIN cut_m r ON {same} AND m.s.metric = r.metric),
orders_of AS (SELECT m.*, ms FROM (SELECT {keys}, n, s.mean AS mean FROM seen) m LEFT JOIN (SELECT {keys}, list_sort(list({first})) AS ms FROM resampled GROUP BY {keys}) r ON {same})"""


def _rank_sql(strategy: str, unit: str = "turn") -> str:
    return f"WITH {_TURNS}{_SCORES} SELECT uid, dim, doc_i, rn FROM ranked WHERE unit = '{unit}' AND strategy = '{strategy}'"


_POLICY = " UNION ALL ".join(
    f"SELECT uid, dim, '{name}' AS policy, doc_i, CAST(row_number() OVER (PARTITION BY uid, dim ORDER BY round({a}::DOUBLE * r + {b}::DOUBLE * (doc_i / greatest(1, n_all - 1)::DOUBLE) + {c}::DOUBLE * cue, 12) DESC, doc_i DESC) AS INT) AS rn FROM rel WHERE unit = 'turn'"
    for name, a, b, c in R.POLICIES
)
_TURN_JOBS = "SELECT {'uid': uid, 'dim': dim} AS job, %s AS budget, rn, doc_i, bytes, session, serialized FROM ranked WHERE unit = 'turn' AND strategy = 'bm25'"
_HITS = f", hit AS (SELECT p.uid, p.doc_i, p.serialized, p.bytes FROM placed p JOIN gold g USING (uid) WHERE unit = 'turn' AND {_has('text', 'm_new')})"
_EXCLUDE = "SELECT {'uid': r.uid, 'dim': r.dim} AS job, 3072 AS budget, rn, r.doc_i, r.bytes, session, r.serialized FROM ranked r ANTI JOIN hit h ON h.uid = r.uid AND h.doc_i = r.doc_i WHERE unit = 'turn' AND strategy = 'bm25'"
_SENS_JOBS = """SELECT {'uid': uid, 'dim': dim, 'alpha': alpha, 'beta': beta} AS job, 4096 AS budget, doc_i, bytes, session, serialized,
  row_number() OVER (PARTITION BY uid, dim, alpha, beta ORDER BY round(r + alpha * recency + beta * cue, 12) DESC, doc_i DESC) AS rn
  FROM rel, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75]::DOUBLE[]) AS alpha), (SELECT unnest([0.0, 0.1, 0.25]::DOUBLE[]) AS beta) WHERE unit = 'turn'"""
def queries() -> dict:
    named = (user_turns, sentences, nested_unnest, token_counts, doc_stats, doc_freq, bm25_scores, rank_policy, policy_faults, pack_stop, pack_greedy, pack_exclude, context_score, dataset_audit, eval_summary, joint_states, paired_contrast, sensitivity, strata, ceiling, bootstrap_ci, bootstrap_ci_order_stat, intervals, sensitivity_intervals, strata_intervals, reader_intervals, reader_summary, missing_bounds, association, blind_labels, reader_arms)
    out = {f.__name__: f for f in named}
    return out | {f"rank_{s}": _rank(s) for s in ("bm25", "timecue", "rrf", "density")} | {"rank_sentence_rrf": _rank("rrf", "sentence")}


def oracle_sql() -> dict[str, str]:
    base = "WITH " + _TURNS
    strata_fields = ", ".join(f"{{'field': '{f}', 'x': {f}::DOUBLE}}" for f in ("history_bytes", "median_turn_bytes", "update_fraction"))
    return {
        "user_turns": base + " SELECT uid, session, turn, rank, doc_i, text, serialized, bytes, round(recency, 9) AS recency, cue FROM placed WHERE unit = 'turn'",
        "sentences": base + " SELECT uid, session, turn, part, rank, doc_i, text, serialized, bytes FROM placed WHERE unit = 'sentence'",
        "nested_unnest": "SELECT uid, session, CAST(ti AS INT) AS ti, role, CAST(strlen(text) AS INT) AS bytes FROM (SELECT conv_id // 10 AS uid, conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ti, role, text FROM conversations) WHERE role = 'user'",
        "token_counts": base + _TERMS + " SELECT uid, doc_i, term, tf FROM terms WHERE unit = 'turn'",
        "doc_stats": base + _TERMS + " SELECT uid, doc_i, length, n_docs, round(avg_length, 9) AS avg_length FROM lens WHERE unit = 'turn'",
        "doc_freq": base + _TERMS + " SELECT uid, term, count(*) AS df FROM terms WHERE unit = 'turn' GROUP BY ALL",
        "bm25_scores": base + _SCORES + " SELECT uid, dim, doc_i, round(score, 9) AS score FROM scored WHERE unit = 'turn'",
        **{f"rank_{s}": _rank_sql(s) for s in ("bm25", "timecue", "rrf", "density")},
        "rank_sentence_rrf": _rank_sql("rrf", "sentence"),
        "rank_policy": base + _SCORES + " " + _POLICY,
        "policy_faults": """WITH p AS (SELECT replace(lower(p_name), ' ', '-') AS name, CASE WHEN p_partkey % 5 > 0 THEN round((p_size - 25) / 20::DOUBLE, 4) ELSE 0 END AS w, p_partkey % 7 = 0 AS gap FROM part)
SELECT name, array_to_string(list_filter([CASE WHEN name IS NULL OR NOT regexp_full_match(name, '[a-z][a-z0-9_-]{0,39}') THEN 'name' END, CASE WHEN gap OR w < 0 OR w > 1 THEN 'weight' END, CASE WHEN w <= 0 THEN 'no weight' END], lambda x: x IS NOT NULL), ',') AS faults FROM p""",
        "pack_stop": base + _SCORES + f""", fit AS (SELECT *, total <= budget AS fits FROM (SELECT *, sum(bytes) OVER (PARTITION BY uid, dim ORDER BY rn) AS total, {_BUDGETS} AS budget FROM ranked WHERE unit = 'turn' AND strategy = 'stop'))
SELECT uid, dim, budget, {_LIST} FROM (SELECT uid, dim, budget, coalesce(list(doc_i ORDER BY doc_i) FILTER (fits), []) AS selected, CAST(coalesce(sum(bytes) FILTER (fits), 0) AS INT) AS bytes,
  coalesce(string_agg(serialized, '' ORDER BY doc_i) FILTER (fits), '') AS context, coalesce(list_sort(list(DISTINCT session) FILTER (fits)), []) AS sessions FROM fit GROUP BY ALL)""",
        "pack_greedy": "WITH RECURSIVE" + _TURNS + _SCORES + _packs(_TURN_JOBS % _BUDGETS) + f" SELECT job.uid AS uid, job.dim AS dim, budget, {_LIST} FROM packs",
        "pack_exclude": "WITH RECURSIVE" + _TURNS + _SCORES + _GOLD + _HITS + _packs(_EXCLUDE) + f" SELECT job.uid AS uid, job.dim AS dim, budget, {_LIST} FROM packs",
        "context_score": _eval() + " SELECT * FROM evals",
        "dataset_audit": base + _GOLD + _AUDIT + " SELECT * FROM audit",
        "eval_summary": _eval() + f" SELECT method, budget, count(*) AS n, {_ROUNDED} FROM (SELECT method, budget, uid, {_MEANS} FROM evals GROUP BY ALL) GROUP BY method, budget",
        "joint_states": _eval() + """ SELECT method, budget, state, count(*) AS n, round(avg(hit), 9) AS mean FROM (SELECT method, budget, uid, state, avg(CAST("old" = o AND "new" = n AS INT)) AS hit
  FROM evals, (VALUES ('neither', 0, 0), ('old_only', 1, 0), ('new_only', 0, 1), ('both', 1, 1)) AS s(state, o, n) GROUP BY ALL) GROUP BY ALL""",
        "paired_contrast": _eval() + _PAIRED + " SELECT method, budget, count(*) AS n, round(avg(diff), 9) AS mean, 'turn_bm25' AS control FROM diffs GROUP BY method, budget",
        "sensitivity": "WITH RECURSIVE" + _TURNS + _SCORES + _GOLD + _packs(_SENS_JOBS) + f""" SELECT alpha, beta, count(*) AS n, round(avg(x), 9) AS "new" FROM (SELECT job.alpha AS alpha, job.beta AS beta, job.uid AS uid, avg(CAST({_has('context', 'm_new')} AS INT)) AS x FROM packs JOIN gold g ON g.uid = job.uid GROUP BY ALL) GROUP BY alpha, beta""",
        "strata": _eval("strategy = 'bm25'", "unnest([4096])") + _AUDIT + _PAIRED + f""", long AS (SELECT uid, v.field AS field, v.x AS x FROM (SELECT uid, unnest([{strata_fields}]) AS v FROM audit)),
cuts AS (SELECT field, median(x) AS cut FROM long GROUP BY field),
sided AS (SELECT field, CASE WHEN x <= cut THEN 'low' ELSE 'high' END AS side, diff FROM long JOIN cuts USING (field) JOIN diffs d ON d.uid = long.uid AND d.method = 'sentence_bm25')
SELECT c.field, round(c.cut, 9) AS cut, c.side, count(diff) AS n, round(avg(diff), 9) AS mean FROM (SELECT *, unnest(['low', 'high']) AS side FROM cuts) c LEFT JOIN sided s ON s.field = c.field AND s.side = c.side GROUP BY ALL""",
        "ceiling": base + _GOLD + _AUDIT + " SELECT CAST(sum(user_exact) AS BIGINT) AS user_exact, CAST(sum(assistant_exact) AS BIGINT) AS assistant_exact, CAST(sum(assistant_only) AS BIGINT) AS assistant_only, CAST(sum(user_token) AS BIGINT) AS user_token FROM audit",
        "bootstrap_ci": _eval() + _SUBJECTS + weights_sql("subjects", 'method, budget', ('"new"',)) + " SELECT method, budget, n, low, high FROM bounds",
        "bootstrap_ci_order_stat": _eval() + _SUBJECTS + weights_sql("subjects", "method, budget", ('"new"',), 2000, 20260929) + " SELECT method, budget, n, mean, round(ms[CAST(floor(len(ms) * 49 / 2000) AS BIGINT) + 1], 9) AS low, round(ms[CAST(floor(len(ms) * 1949 / 2000) AS BIGINT) + 1], 9) AS high FROM orders_of",
        "intervals": _eval() + _ALL + weights_sql("per", "method, budget", (*(f'"{m}"' for m in E.METRICS), *(f'"{s[0]}"' for s in E.STATES), "paired")) + " SELECT * FROM bounds WHERE NOT (metric = 'paired' AND method = 'turn_bm25')",
        "sensitivity_intervals": "WITH RECURSIVE" + _TURNS + _SCORES + _GOLD + _packs(_SENS_JOBS) + f""", per AS (SELECT job.alpha AS alpha, job.beta AS beta, job.uid AS uid, avg(CAST({_has('context', 'm_new')} AS INT)) AS "new" FROM packs JOIN gold g ON g.uid = job.uid GROUP BY ALL)"""
        + weights_sql("per", "alpha, beta", ('"new"',)) + " SELECT * FROM bounds",
        "strata_intervals": _eval("strategy = 'bm25'", "unnest([4096])") + _AUDIT + _PAIRED + f""", long AS (SELECT uid, v.field AS field, v.x AS x FROM (SELECT uid, unnest([{strata_fields}]) AS v FROM audit)),
cuts AS (SELECT field, median(x) AS cut FROM long GROUP BY field),
sided AS (SELECT long.uid, field, CASE WHEN x <= cut THEN 'low' ELSE 'high' END AS side, diff FROM long JOIN cuts USING (field) JOIN diffs d ON d.uid = long.uid AND d.method = 'sentence_bm25'),
per AS (SELECT c.field, c.side, s.uid, s.diff FROM (SELECT *, unnest(['low', 'high']) AS side FROM cuts) c LEFT JOIN sided s ON s.field = c.field AND s.side = c.side)""" + weights_sql("per", "field, side", ("diff",)) + " SELECT * FROM bounds",
        "reader_intervals": _READ_EVAL + ', per AS (SELECT model, arm, uid, CAST(CAST(pass AS INT) AS DOUBLE) AS pass FROM readers WHERE graded)' + weights_sql("per", "model, arm", ("pass",)) + " SELECT * FROM bounds",
        "reader_summary": _READ_EVAL + """ SELECT model, arm, count(*) AS attempted, CAST(sum(CAST(answered AS INT)) AS BIGINT) AS answered, CAST(sum(CAST(graded AS INT)) AS BIGINT) AS graded, CAST(coalesce(sum(CAST(pass AS INT)), 0) AS BIGINT) AS passed,
  coalesce(sum(CAST(pass AS INT)), 0) / count(*)::DOUBLE AS missing_as_failure, avg(CAST(pass AS INT)) AS mean FROM readers GROUP BY model, arm""",
        "missing_bounds": _READ_EVAL + """ SELECT a.model, count(*) AS scheduled_pairs, avg(coalesce(CAST(a.pass AS INT), 0) - coalesce(CAST(b.pass AS INT), 1)) AS low, avg(coalesce(CAST(a.pass AS INT), 1) - coalesce(CAST(b.pass AS INT), 0)) AS high,
  count(CAST(a.pass AS INT) - CAST(b.pass AS INT)) AS n, avg(CAST(a.pass AS INT) - CAST(b.pass AS INT)) AS mean, a.arm AS treatment, b.arm AS control
  FROM readers a JOIN readers b ON a.model = b.model AND a.uid = b.uid AND ((a.arm = 'sentence_bm25' AND b.arm = 'turn_bm25') OR (a.arm = 'oracle_update' AND b.arm = 'oracle_sham')) GROUP BY ALL""",
        "association": _READ_EVAL + """ SELECT f.model, f.new_present, count(r.pass) AS n_responses, avg(CAST(r.pass AS INT)) AS pass_rate FROM (SELECT DISTINCT model, unnest([0, 1]) AS new_present FROM readers) f
  LEFT JOIN readers r ON r.model = f.model AND r."new" = f.new_present AND r.graded AND r.arm IN ('turn_bm25', 'sentence_bm25') GROUP BY ALL""",
        "blind_labels": _READ_EVAL + """ SELECT uid, model, CASE model WHEN 'm1' THEN 'm2' ELSE 'm1' END AS judge, 'response_' || row_number() OVER (PARTITION BY uid, model ORDER BY sha256('blind:' || id)) AS label, id FROM readers WHERE answered""",
        "reader_arms": "WITH RECURSIVE" + _TURNS + _SCORES + _GOLD + _HITS + _packs("""SELECT {'uid': uid, 'arm': unit || '_bm25'} AS job, 4096 AS budget, rn, doc_i, bytes, session, serialized FROM ranked WHERE strategy = 'bm25' AND dim = 'frequent'
  UNION ALL SELECT {'uid': r.uid, 'arm': 'base'}, 3072, rn, r.doc_i, r.bytes, session, r.serialized FROM ranked r ANTI JOIN hit h ON h.uid = r.uid AND h.doc_i = r.doc_i WHERE unit = 'turn' AND strategy = 'bm25' AND dim = 'frequent'""") + """,
 target AS (SELECT uid, arg_max(serialized, doc_i) AS upd, arg_max(bytes, doc_i) AS size FROM hit GROUP BY uid HAVING arg_max(bytes, doc_i) <= 1024),
 arms AS (SELECT job.uid AS uid, job.arm AS arm, context FROM packs WHERE job.arm <> 'base'
   UNION ALL SELECT p.job.uid, x.arm, p.context || x.c FROM (SELECT p, unnest([{'arm': 'oracle_update', 'c': upd}, {'arm': 'oracle_sham', 'c': '[withheld evidence] ' || repeat(' ', greatest(0, size - 20))}]) AS x FROM packs p JOIN target t ON t.uid = p.job.uid WHERE p.job.arm = 'base'))
SELECT uid, arm, CAST(strlen(context) AS INT) AS bytes, sha256(context) AS context_sha256 FROM arms""",
    }

"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character-class histogram and its common-word histogram are compared with those of each reference language
by Jensen-Shannon distance (base 2, 0 to 1). A document of at least `min_words` words is rejected when even the nearest
language is farther than a threshold, in characters or in both distances together; shorter ones give too few counts and are not judged by distance. Beside that stand
the base figures: words, their characters, symbols, repeated lines, and words in repeated five-word windows.
Null texts count as empty (0 words, base_failed). Texts are judged whole, however long; rows, repeated or not, are judged
one by one; other columns are ignored, or kept under any names; an empty table gives an empty result. Map-only: no
shuffle, no join. The references below are rounded figures of the languages at large; `references` takes others from
texts of one's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, unpacked, whole_row

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Thresholds, fitted on the labelled documents of 50 words or more that pass the base figures (3,233 good, 290 bad): both
#: distances of good ones together stay below 0.40; 28 bad ones stay below 0.45, 7 below 0.42.
MAX_CHAR_DISTANCE = 0.30
MAX_BOTH = 0.42
#: Shares of blanks, digits, symbols, bytes beyond one a character, and all other characters.
CHAR_REFERENCE = {
    "en": (0.16, 0.005, 0.002, 0.002, 0.831),
    "de": (0.15, 0.005, 0.002, 0.030, 0.813),
    "fr": (0.16, 0.005, 0.002, 0.070, 0.763),
    "es": (0.16, 0.005, 0.002, 0.040, 0.793),
}
#: Common words and their shares of all words, in per mille; what is left counts as other words.
WORD_REFERENCE = {
    "en": {"the": 40, "of": 28, "and": 20, "to": 20, "a": 14, "in": 14, "is": 10, "that": 9},
    "de": {"der": 30, "die": 30, "und": 25, "in": 16, "den": 14, "das": 12, "zu": 12, "von": 10},
    "fr": {"de": 40, "la": 30, "le": 28, "et": 20, "les": 18, "des": 18, "que": 12, "en": 12},
    "es": {"de": 45, "la": 33, "que": 28, "el": 26, "en": 24, "y": 22, "los": 14, "se": 12},
}


def _distance(p: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of the counts p (sum: total) from the reference shares."""
    share = F.transform(p, lambda n: n / F.greatest(total, F.lit(1)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share, F.array(*map(F.lit, reference)), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _common(reference: dict[str, dict[str, int]]) -> list[str]:
    return sorted({w for words in reference.values() for w in words})


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = 8) -> tuple[dict, dict]:
    """Character and word references of each language from texts known to be good, in the form of the fixed ones: shares of
    the five classes, and the commonest words in per mille. Only languages times `words` rows leave the executors."""
    t = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    blank, digit, symbol = (F.length("t") - F.length(F.regexp_replace("t", f"[{kept}]+", "")) for kept in (SPACE, "0-9", SYMBOLS))
    sums = t.groupBy("lang").agg(*(F.sum(c).alias(n) for n, c in (("blank", blank), ("digit", digit), ("symbol", symbol), ("chars", F.length("t")), ("bytes", F.octet_length("t")))))
    chars = {}
    for r in sums.collect():
        wide, mass = r["bytes"] - r["chars"], max(r["bytes"], 1)
        parts = (r["blank"], r["digit"], r["symbol"], wide, r["chars"] - r["blank"] - r["digit"] - r["symbol"])
        chars[r["lang"]] = tuple(round(p / mass, 4) for p in parts)
    seen = t.select("lang", F.explode(F.filter(F.split(F.lower("t"), f"[{SPACE}]+"), lambda w: w.rlike("^[a-z]+$"))).alias("word")).groupBy("lang", "word").count()
    total = t.groupBy("lang").agg(F.sum(F.size(F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != ""))).alias("total"))
    best = seen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).filter(F.col("rank") <= words)
    common: dict[str, dict[str, int]] = {}
    for r in best.join(total, "lang").orderBy("lang", "rank").collect():
        common.setdefault(r["lang"], {})[r["word"]] = round(1000 * r["count"] / r["total"])
    return chars, common


def _equals(word: str):
    return lambda x: x == word


def _repeats(h: Column) -> Column:
    """Words in five-word windows whose hash occurs twice or more; h: the windows' hashes in order."""
    marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
        twice = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.sequence(e["i"], e["i"] + 4)))))

    # the array of one element binds the sorted windows, which would else be sorted anew for each window
    many = F.transform(F.array(marked), covered)[0]
    return F.when(F.size(F.array_distinct(h)) < F.size(h), many).otherwise(F.lit(0))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_both: float = MAX_BOTH, char_reference: dict = CHAR_REFERENCE, word_reference: dict = WORD_REFERENCE) -> DataFrame:
    """The figures and verdict of every row; keep: with all columns of docs in a struct `row`."""
    first = [whole_row(docs)] if keep else []
    known = _common(word_reference)
    t = docs.select(*first, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = [*(["row"] if keep else []), "doc_id"]
    words = F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    t = t.select(*base, "t", words.alias("words"), lines.alias("lines"))
    t = t.withColumn("n", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    five = lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(5)))
    h = F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 5, F.lit(0))), five)).otherwise(F.array().cast("array<bigint>"))
    # the common words are ASCII, and no other letter of theirs lower-cases to ASCII
    common = F.transform(F.filter("words", lambda w: F.lower(w).isin(known)), F.lower)
    chars = F.length("t")
    only = lambda kept: F.length(F.regexp_replace("t", f"[^{kept}]+", ""))
    t = t.select(
        *base,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        chars.alias("chars"),
        (F.octet_length("t") - chars).alias("wide"),
        only("0-9").alias("digits"),
        only(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        h.alias("h"),
        common.alias("common"),
    )
    blanks = F.col("chars") - F.col("word_chars")
    classes = [blanks, F.col("digits"), F.col("n_symbols"), F.col("wide"), F.col("word_chars") - F.col("digits") - F.col("n_symbols")]
    counts = {w: f"count_{i}" for i, w in enumerate(known)}
    t = t.select(
        *base, "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeats(F.col("h")).cast("long").alias("n_repeat_words"),
        F.array(*(c.cast("double") for c in classes)).alias("classes"), (F.col("chars") + F.col("wide")).alias("mass"),
        *(F.size(F.filter("common", _equals(w))).alias(name) for w, name in counts.items()),
    )

    def words_from(reference: dict[str, int]) -> Column:
        seen = [F.col(counts[w]) for w in reference]
        rest = F.col("n_words") - sum(seen[1:], seen[0])
        shares = [x / 1000 for x in reference.values()]
        return _distance(F.array(*(c.cast("double") for c in [*seen, rest])), F.col("n_words"), [*shares, 1 - sum(shares)])

    char = F.least(*(_distance(F.col("classes"), F.col("mass"), list(r)) for r in char_reference.values()))
    word = F.least(*map(words_from, word_reference.values()))
    t = t.withColumn("char_distance", F.round(char, 4)).withColumn("word_distance", F.round(word, 4))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.col("n_words") < min_words) | ((F.col("char_distance") <= max_char) & (F.col("char_distance") + F.col("word_distance") <= max_both))
    return t.select(*base, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "char_distance", "word_distance")


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The documents that pass, with their own columns."""
    judged = quality(docs, keep=True, **how)
    # a plain filter would be pushed down, and with it the verdict's expressions into each other; a generator isn't
    kept = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return unpacked(kept.filter("row IS NOT NULL"), docs)


def oracle() -> str:
    sym = "".join(SYMBOLS)
    chars = "[blanks, digits, n_symbols, wide, word_chars - digits - n_symbols]"

    def distance(values: str, total: str, reference) -> str:
        q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in reference) + "]"
        pair = f"list_transform(list_zip(list_transform({values}, lambda n: n::DOUBLE / greatest({total}, 1)), {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))"
        return f"sqrt(greatest(list_sum({pair}) / 2, 0))"

    def words(reference) -> str:
        seen = [f"len(list_filter(lows, lambda w: w = '{w}'))" for w in reference]
        shares = [x / 1000 for x in reference.values()]
        return distance(f"[{', '.join(seen)}, n_words - ({' + '.join(seen)})]", "n_words", [*shares, 1 - sum(shares)])

    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS words,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM documents),
     win AS (SELECT doc_id, i, words[i:i+4] AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM a WHERE len(words) >= 5)),
     rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
     cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(5) AS r(k) GROUP BY doc_id),
     b AS (SELECT a.doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS word_chars, length(t) AS chars,
       strlen(t) - length(t) AS wide, length(t) - length(translate(t, '0123456789', '')) AS digits,
       length(t) - length(translate(t, '{sym}', '')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, list_transform(words, lambda w: translate(w, '{UPPER}', '{LOWER}')) AS lows
       FROM a LEFT JOIN cov ON a.doc_id = cov.doc_id),
     c AS (SELECT *, chars - word_chars AS blanks FROM b),
     d AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       round(least({', '.join(distance(chars, '(chars + wide)', r) for r in CHAR_REFERENCE.values())}), 4) AS char_distance,
       round(least({', '.join(words(r) for r in WORD_REFERENCE.values())}), 4) AS word_distance FROM c)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {MIN_WORDS} OR (char_distance <= {MAX_CHAR_DISTANCE} AND char_distance + word_distance <= {MAX_BOTH})) AS kept,
  char_distance, word_distance FROM d"""

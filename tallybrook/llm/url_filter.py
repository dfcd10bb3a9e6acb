"""URL filters: host/path rules, else a weighted vocabulary matched by one Aho-Corasick automaton.

The automaton finds every vocabulary term in one pass over the URL. A hit counts only between boundaries (no ASCII
letter or digit on either side), and a term counts once. A soft term weighs 1, a strict one as much as it takes to
block: `soft_needed`; a URL whose distinct terms weigh that much is rejected. A rule that fits the URL decides first.
Null or scheme-less URLs have an empty host and path, fit no rule, and are still searched for terms (null: none, so they
are allowed). Long URLs are searched whole; repeated rows stay repeated; an empty table gives an empty result; other
columns of the input, whatever their names, are ignored. Map-only: no shuffle; the automaton has a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
#: Vocabulary terms, lower case: adult, gambling, pharmacy, fraud and advertising, in English and in the
#: other languages of the corpus.
STRICT = tuple(
    "adult apuestas bdsm blackjack bukkake camgirl camgirls casino casinos cialis clickbait doubleclick escort escorts "
    "erotik fetish gangbang glucksspiel hentai jackpot keygen levitra malware milf nsfw nude nudes payday phishing porn "
    "porno pornos roulette scam sexcam slots spam sportwetten strippers tadalafil viagra warez webcamsex wetten xanax xxx"
    .split()
)
SOFT = tuple(
    "ad ads adserver adsense affiliate affiliates argent banner banners bet bets betting bonus bookmaker buy cam cams "
    "cash cheap clic click clicks coupon coupons crack cracked credit crypto dating deal deals diet dinero discount "
    "download drugs earn escort-service farm forex free gagner gambling ganar geld gewinn girls gratis gratuit hot "
    "invest kostenlos kredit loan loans lottery lotto lucky mature millionaire money naked offer offers odds "
    "pharma pharmacy pill pills poker popunder popup prestamo prize profit promo promos rabatt replica rich seo serial "
    "sex sexy singles slim sponsor sponsored sweepstakes teens torrent track tracker tracking trader traffic unlimited "
    "vegas weightloss win winner winners"
    .split()
)
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight int"
_FOLD = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    tail = rest[len(host) :]
    return host.translate(_FOLD), re.split(r"[?#]", tail, maxsplit=1)[0]


def _alnum(ch: str) -> bool:
    return ("a" <= ch <= "z") or ("0" <= ch <= "9")


def build_automaton(strict, soft):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):
        for term in terms:
            found.add_word(term, (kind, term))
    if len(found):
        found.make_automaton()
    return found


def hits(automaton, url: str | None) -> tuple[int, int]:
    """Distinct strict and soft terms that stand between boundaries."""
    if not url or not len(automaton):
        return 0, 0
    low, seen = url.translate(_FOLD), (set(), set())
    for end, (kind, term) in automaton.iter(low):
        start = end - len(term) + 1
        if (start == 0 or not _alnum(low[start - 1])) and (end + 1 == len(low) or not _alnum(low[end + 1])):
            seen[kind].add(term)
    return len(seen[0]), len(seen[1])


def filter_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, deciding rule or null, verdict and the term counts."""
    ordered = sorted(rules, key=lambda r: -len(str(r)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(strict, soft)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = next((r for r in ordered if r.fits(host, path)), None)
                n_strict, n_soft = hits(automaton, url)
                weight = n_strict * soft_needed + n_soft
                verdict = rule.verdict if rule else "block" if weight >= soft_needed else "allow"
                for column, value in zip(out, (host, path, str(rule) if rule else None, verdict, n_strict, n_soft, weight), strict=True):
                    column.append(value)
            kinds = (pa.string(),) * 4 + (pa.int32(),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    from pyspark.sql import functions as F

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(judge, SCHEMA)


def _term_sql(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)


def oracle() -> str:
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {i}"
        for i, r in enumerate(sorted(RULES, key=lambda r: -len(str(r))))
    )
    ordered = sorted(RULES, key=lambda r: -len(str(r)))
    name = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ordered))
    says = " ".join(f"WHEN {i} THEN '{r.verdict}'" for i, r in enumerate(ordered))
    return f"""
WITH cut AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS low,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     part AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
     hit AS (SELECT page_id, host, path, CASE {cases} END AS n,
         CAST(coalesce({_term_sql(STRICT)}, 0) AS INT) AS strict_hits, CAST(coalesce({_term_sql(SOFT)}, 0) AS INT) AS soft_hits FROM part)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE n {name} END AS rule,
  CASE n {says} ELSE CASE WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END END AS verdict,
  strict_hits, soft_hits, CAST(2 * strict_hits + soft_hits AS INT) AS weight FROM hit"""

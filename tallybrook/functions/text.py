"""Text functions as Spark expressions; the general Unicode forms are Arrow-batched."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no weight in ranking.
STOP_WORDS = (
    "a an the i me my you your we our and or of to for in on at is are was were be been being it this that with as from by do does did can could would should have has had "
    "if so how what when where which please user still based history conversation"
).split()
#: The code points that count as white space between words and at the ends of sentences.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Text whose compatibility form is itself and whose case folds letter by letter, but for the sharp s.
PLAIN = r"\A[\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF\x{2013}\x{2014}\x{2018}-\x{201D}]*\z"
#: Words that hint at a change.
CHANGE_CUES = ("now", "anymore", "no longer", "instead", "since", "recently", "changed", "switched", "started", "stopped", "quit", "moved", "new", "but", "however", "actually")
#: What is redacted.
SECRETS = (r"sk-[A-Za-z0-9_-]{12,}",)
#: What a scan before publication looks for.
CREDENTIALS = (r"(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{24,}", r"gh[pousr]_[A-Za-z0-9]{30,}", r"github_pat_[A-Za-z0-9_]{30,}", r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----")
#: As CREDENTIALS, but a private key goes whole, to the end of the text if its last line is missing.
REDACTED = (*SECRETS, *CREDENTIALS[1:3], CREDENTIALS[3] + r"[\s\S]*?(?:-----END (?:RSA |OPENSSH |EC )?PRIVATE KEY-----|\z)")


def tokens(text: Column, stop=STOP_WORDS) -> Column:
    """Lower-case alphanumeric runs without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words


def is_plain(text: Column) -> Column:
    """Whether normalize() can do without Python; null for null."""
    return text.rlike(PLAIN)


def normalize(text: Column, odd: bool = True) -> Column:
    """Compatibility composition, collapsed white space, full case folding. Plain text stays inside the JVM; only other
    text is sent to Python. odd=False says that there is none."""
    collapsed = F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", " "), r"\A | \z", "")
    folded = F.replace(F.lower(collapsed), F.lit("ß"), F.lit("ss"))
    if not odd:
        return folded
    plain = is_plain(text)
    return F.when(plain, folded).otherwise(normalize_any(F.when(~plain, text)))


@F.pandas_udf(StringType())
def normalize_any(text: pd.Series) -> pd.Series:
    """The same for any text; nulls stay null."""
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold()
    return text.map(fold, na_action="ignore")


def has_cue(text: Column, cues=CHANGE_CUES) -> Column:
    return text.rlike(rf"(?i)\b({'|'.join(cues)})\b")


def sentences(text: Column) -> Column:
    """What stands between line ends, or after a full stop, question or exclamation mark with white space behind it."""
    parts = F.split(text, rf"(?<=[.!?]){BLANK}+|\n+")
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, rf"\A{BLANK}+|{BLANK}+\z", ""))
    return F.filter(trimmed, lambda s: s != "")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def includes(context: Column, statement: Column) -> Column:
    """The normalised statement stands in the normalised context."""
    return F.contains(normalize(context), normalize(statement))


def spaced(normal: Column) -> Column:
    """The words of a normalised text, with a blank on both sides of each."""
    return F.concat(F.lit(" "), F.array_join(words_of(normal), " "), F.lit(" "))


def includes_tokens(context: Column, statement: Column) -> Column:
    """The statement's words stand in the context as an unbroken run; false without words."""
    return F.contains(spaced(normalize(context)), spaced(normalize(statement))) & (F.size(words_of(normalize(statement))) > 0)


def redact(text: Column, patterns=REDACTED, key: Column | None = None) -> Column:
    """Text without what the patterns find, and without the literal key of its row, if it has one."""
    if key is not None:
        text = F.when(F.coalesce(key, F.lit("")) != "", F.replace(text, key, F.lit("[REDACTED]"))).otherwise(text)
    for p in patterns:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


#: Folders and files that aren't shared, suffixes of artifacts, and the size from which a file is one.
PRIVATE = (".local", ".venv", "vendor", "data", "research", "paper", "submissions", "outputs", "projects", "__pycache__")
TOKEN_FILE, ARTIFACTS, LARGE = "PaperReview-AccessToken.txt", (".zip", ".pdf", ".pyc"), 5_000_000


def share_issues(path: Column, content: Column) -> Column:
    """What keeps a file (relative path, text) from being shared. Folders of a project's configuration may have any name
    in their first two parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    configured = F.array_join(F.slice(parts, 1, 2), "/") == "config/projects"
    judged = F.when(configured, F.slice(parts, 3, 1 << 20)).otherwise(parts)
    name = F.coalesce(F.element_at(parts, F.when(F.size(parts) > 0, -1)), F.lit(""))
    suffix = F.lower(F.regexp_extract(name, r"(?s)[^.].*(\.[^.]+)\z|\A[^.](\.[^.]+)\z", 1))
    short = F.lower(F.regexp_extract(name, r"(?s)\A[^.](\.[^.]+)\z", 1))
    found = [
        F.when(F.arrays_overlap(judged, F.array(*map(F.lit, PRIVATE))) | (name == TOKEN_FILE), "private path"),
        F.when(F.startswith(name, F.lit(".env")) & (name != ".env.example"), "credential file"),
        F.when((F.octet_length(content) > LARGE) | suffix.isin(*ARTIFACTS) | short.isin(*ARTIFACTS), "large/binary artifact"),
        F.when(F.coalesce(content.rlike("|".join(CREDENTIALS)), F.lit(False)), "possible credential"),
    ]
    return F.array_compact(F.array(*found))


def locate(text: Column, excerpt: Column) -> Column:
    """Zero-based place of the first occurrence, null if there is none."""
    return F.when(F.instr(text, excerpt) > 0, F.instr(text, excerpt) - 1)


def pointer_path(pointer: str) -> str:
    """A JSON pointer as a JSON path."""
    path = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        path += f"[{part}]" if part.isdigit() else f"['{part}']"
    return path


def usage(raw: Column) -> Column:
    """Token usage from either field naming, or null if a count is missing or negative. raw: struct of longs."""
    given = F.coalesce(raw["input_tokens"], raw["prompt_tokens"])
    made = F.coalesce(raw["output_tokens"], raw["completion_tokens"])
    total = F.greatest(F.coalesce(raw["total_tokens"], F.lit(0)), given + made)
    part = lambda x, most: F.when((x >= 0) & (x <= most), x).otherwise(F.lit(0))
    out = F.struct(
        given.alias("input_tokens"), made.alias("output_tokens"), total.alias("total_tokens"),
        part(F.coalesce(raw["cached_input_tokens"], F.lit(0)), given).alias("cached_input_tokens"),
        part(F.coalesce(raw["reasoning_output_tokens"], F.lit(0)), made).alias("reasoning_output_tokens"),
    )
    return F.when((given >= 0) & (made >= 0), out)


TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex_escape(text: Column) -> Column:
    """Ten special characters escaped in one pass."""
    table = F.create_map(*(F.lit(x) for pair in TEX.items() for x in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def outcome(delta: Column, maximize: bool = True) -> Column:
    signed = delta if maximize else -delta
    return F.when(signed > 0, "improved").when(signed < 0, "worsened").otherwise("matched")


def answer(values: Column) -> Column:
    """UNKNOWN without values, the value if there is one, else CONFLICT."""
    distinct = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(distinct) == 0, "UNKNOWN").when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise("CONFLICT")

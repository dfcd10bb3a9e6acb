"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes some twenty statistics (shares of character classes, repeated words and lines, lengths). Centred and
scaled by their means and deviations over all documents, they go through D random cosines, whose inner products
approximate a Gaussian kernel. Ridge regression on them needs only the sums of outer products: tasks add up their own rows'
and Spark adds up the tasks', (D + 1)(D + 2) / 2 numbers, which alone reach the driver. Cosines are rounded to multiples
of 2^-16, so that all sums are exact and don't depend on the order in which rows and tasks come. Scores are then calibrated:
documents that took no part in the regression are counted by score, in bins of a thousandth, pool-adjacent-violators makes
the share of good ones rise with the score, and between the pools' means it is interpolated.

Labels are learnt only from rows that aren't held out: crc32(doc_id as text) mod 5 is 1 to 3 for the regression, 4 for the
calibration, and 0 held out. Language, source, id and label are no inputs of a score. All labelled rows are used, none
sampled.

Null texts count as empty; empty texts have statistics like others, all zero. Texts are read whole, long ones piece by
piece. Rows without id are scored and never learnt from. Rows that agree in id and statistics are learnt from once and
scored each. A document with several label rows has their mean quality; null labels are left out. Without any label to
learn from all scores are 0.5. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
THRESHOLD = 0.3
#: Random cosines, the seed of their directions, the kernel's width in deviations, the ridge's weight a row.
FEATURES = 256
SEED = 13
WIDTH = 6.0
RIDGE = 1e-3
#: Statistics farther from the mean than this count as that far.
FAR = 6.0
#: Cosines are multiples of 1 / GRAIN; ridge scores are counted in bins of 1 / BINS.
GRAIN = 2.0**16
BINS = 1000
#: Rows whose outer products a task adds up before it sends them on.
PER_TASK = 50_000
PIECE = 1 << 20

_BLANK, _BREAK = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"\n")
_ODD = frozenset(b"|!#$%&*<>{}[]\\^~`=_@+")
_MIX = np.int64(0x5851F42D4C957F2D)
_LOWER, _UPPER, _DIGIT = (np.arange(a, b) for a, b in ((97, 123), (65, 91), (48, 58)))
_CLASSES = [_LOWER, _UPPER, _DIGIT, *(np.frombuffer(s, np.uint8) for s in (b"|", b"!", b"#$%&*", b"<>{}[]\\^~`=_@+", b".", b",;:?", b"\"'()-/", b"\n", b" \t\r\x0b\x0c")), np.arange(128, 256)]
STATISTICS = [
    "log_words", "word_length", "distinct", "repeated_before", "distinct_pairs", "commonest", "capitalised", "all_capitals", "odd_ends",
    "log_lines", "words_a_line", "repeated_lines", "entropy", "lower", "upper", "digits", "bars", "shouts", "symbols", "brackets", "stops", "pauses", "quotes", "breaks", "blanks", "wide",
]
_STATS = "doc_id long, stats array<float>"


def _pieces(text: bytes, stop: re.Pattern = _BLANK) -> Iterator[bytes]:
    """The text in pieces that end before a stop, which begins the next."""
    at = 0
    while at < len(text):
        found = stop.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, items), np.int64, len(items))


def statistics(text: bytes) -> list[float]:
    """STATISTICS of a UTF-8 text; 0 for an empty one. Of a long text hashes of words and lines are held, not themselves."""
    chars = capitalised = loud = odd = 0
    held, lines, of = [], [], np.zeros(256, np.int64)
    for piece in _pieces(text):
        words = piece.split()
        held.append(_hashes(words))
        chars += len(b"".join(words))
        for w, c in Counter(words).items():
            capitalised += c * (65 <= w[0] <= 90)
            loud += c * (w.isupper() and len(w) > 1)
            odd += c * (w[-1] in _ODD)
    for piece in _pieces(text, _BREAK):
        lines.append(_hashes([x for x in piece.split(b"\n") if x.strip()]))
    for at in range(0, len(text), PIECE):
        of += np.bincount(np.frombuffer(text[at : at + PIECE], np.uint8), minlength=256)
    h, line = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (held, lines))
    counts = np.unique(h, return_counts=True)[1]
    n, n_lines, size = max(len(h), 1), max(len(line), 1), max(len(text), 1)
    shares = of[of > 0] / size
    stats = [
        math.log1p(len(h)), math.log1p(chars / n), len(counts) / n, int((h[1:] == h[:-1]).sum()) / n, len(np.unique(h[:-1] * _MIX + h[1:])) / n,
        int(counts.max(initial=0)) / n, capitalised / n, loud / n, odd / n,
        math.log1p(len(line)), math.log1p(len(h) / n_lines), (len(line) - len(np.unique(line))) / n_lines, abs(float((shares * np.log2(shares)).sum())),
    ]
    return stats + [float(of[c].sum()) / size for c in _CLASSES]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float32()))], ["doc_id", "stats"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(_measure, _STATS)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def scales(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over all rows, to six digits."""
    at = range(len(STATISTICS))
    sums = rows.agg(*(F.avg(F.get("stats", F.lit(i))) for i in at), *(F.stddev_pop(F.get("stats", F.lit(i))) for i in at)).first()
    both = np.array([float(f"{v or 0.0:.6g}") for v in sums]).reshape(2, -1)
    return both[0], np.where(both[1] > 1e-6, both[1], 1.0)


class Cosines:
    """Random Fourier features of a Gaussian kernel, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.directions = rng.normal(size=(len(mean), features)) / width
        self.phases = rng.uniform(0, 2 * math.pi, features)

    def of(self, column: pa.Array) -> np.ndarray:
        stats = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, len(self.mean))
        near = np.clip((stats - self.mean) / self.deviation, -FAR, FAR)
        waves = np.cos(near @ self.directions + self.phases)
        return np.hstack([np.round(waves * GRAIN) / GRAIN, np.ones((len(near), 1))])


def normal_equations(rows: DataFrame, cosines: Cosines, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the outer products of features, and of features times target. rows: stats, target."""
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1), dtype=np.int64)
        for batch in batches:
            z = cosines.of(batch.column(0))
            y = np.round(np.asarray(batch.column(1), dtype=np.float64) * GRAIN) / GRAIN
            # multiples of 2^-32 below 2^21 in sum: doubles hold them exactly
            total += (z.T @ np.hstack([z, y[:, None]]) * GRAIN**2).astype(np.int64)
        at, values = np.concatenate([upper[0] * (size + 1) + upper[1], np.arange(size) * (size + 1) + size]), np.concatenate([total[:, :-1][upper], total[:, -1]])
        if total[-1, -2]:  # rows seen
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values)], ["at", "value"])

    sums = rows.mapInArrow(add, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    whole = np.zeros(size * (size + 1))
    for r in sums:
        whole[r["at"]] = float(r["value"]) / GRAIN**2
    whole = whole.reshape(size, size + 1)
    a = np.triu(whole[:, :-1])
    return a + np.triu(a, 1).T, whole[:, -1]


def ridge(a: np.ndarray, b: np.ndarray, weight: float = RIDGE) -> np.ndarray:
    """Coefficients; the constant, last, isn't shrunk."""
    shrink = np.full(len(b), weight * a[-1, -1] + 1e-3)
    shrink[-1] = 0.0
    return np.linalg.solve(a + np.diag(shrink), b)


def isotonic(x, weight, mean) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: the pools' mean x and mean value, both ascending."""
    pools: list[list[float]] = []  # weight, sum of x, sum of values
    for p, w, m in zip(x, weight, mean, strict=True):
        pools.append([w, w * p, w * m])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


def _binned(rows: DataFrame, cosines: Cosines, weights: np.ndarray) -> DataFrame:
    """Rows' bin of the ridge score, clipped to -1 to 2, and their target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.round(np.clip(cosines.of(batch.column(0)) @ weights, -1, 2) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "target"])

    return rows.mapInArrow(run, "bin int, target double")


def fit(rows: DataFrame, labels: DataFrame, features: int = FEATURES) -> tuple:
    """What scored() needs: cosines, weights and the calibration's knots. rows: doc_id, stats."""
    mean, deviation = scales(rows)
    cosines = Cosines(mean, deviation, features)
    said = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("target"))
    learnt = rows.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).join(said, "doc_id").groupBy("doc_id", "stats").agg(F.first("target").alias("target"))
    learnt = cut(learnt.select("stats", "target", (fold(F.col("doc_id")) == CALIBRATION).alias("calibrates")))
    n, m = learnt.agg(F.count_if(~F.col("calibrates")), F.count_if("calibrates")).first()
    knots = (np.zeros(1), np.full(1, 0.5))
    weights = np.zeros(features + 1)
    if n:
        part = learnt.filter(~F.col("calibrates")).select("stats", "target").repartition(max(1, math.ceil(n / PER_TASK)))
        weights = ridge(*normal_equations(part, cosines, features + 1))
        bins = _binned(learnt.filter("calibrates" if m else "NOT calibrates").select("stats", "target"), cosines, weights)
        held = sorted(map(tuple, bins.groupBy("bin").agg(F.count("*").alias("n"), F.avg("target").alias("mean")).collect()))  # at most 3 BINS + 1 rows
        knots = isotonic([b / BINS for b, _, _ in held], [c for _, c, _ in held], [v for _, _, v in held])
    discard(learnt)
    return cosines, weights, knots


def scored(rows: DataFrame, cosines: Cosines, weights: np.ndarray, knots: tuple) -> DataFrame:
    """doc_id and score, 0 to 1. rows: doc_id, stats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(np.interp(cosines.of(batch.column(1)) @ weights, *knots), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = cut(measured(docs))
    out = scored(rows, *fit(rows, labels))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

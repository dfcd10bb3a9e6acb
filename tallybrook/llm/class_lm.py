"""LM scoring with a class-based n-gram model over the whole vocabulary.

1. Texts are read once: parts of some MB hold their documents as numbers of the part's own words, and send their words
   with training counts to word buckets. Buckets sum them, which gives tokens and distinct words, and number their words.
2. There are half as many classes as the cube root of the vocabulary, `LEAST_CLASSES` at least. Twice as many of the most
   frequent words are clustered first, by exchange on the driver (their bigrams are a table of that size). This is only
   where the classes start from.
3. Then every word of the training documents, frequent or seen once, takes part in rounds of exchange: parts count the
   classes before and after each of their words, buckets sum these counts, and each word moves to the class that raises
   the class bigram likelihood most, all others staying where they are. The bigrams of classes are summed anew over all
   training documents in each round; a round after which they are less likely is taken back, and when a round gains less
   than `GAIN` a token, it was the last.
4. Transitions are those counts of the last round. Parts fetch counts and final classes of their words, and a text's score
   sums log10 of P(class | class before) * P(word | class) over its words and the end.

P(word | class) is (count - DISCOUNT) / tokens of the class; what this leaves is the class's probability of a word that
no training document has, so a class's emissions sum to one. The classes after an unknown word are those after words
seen once. Transitions add TRANSITION pseudo-counts, spread as the classes are.

Held out are documents whose crc32 of the id (as text; a null id counts as the empty string) leaves `remainder`. A null
text is an empty one: its only token is the end, whose class is its own. Repeated rows each count and each get their
row; other columns, whatever their names, are not read; an empty table gives an empty result; texts are scored whole,
and long ones are split into words piece by piece.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cogrouped, grouped, table_of
from .common import chunk_count, cut, discard

MODULUS, REMAINDER = 7, 2
#: Words, at least, that are clustered on the driver before all words are, everywhere.
SEEDS = 256
#: Classes of words, at least, the end's own class 0 included.
LEAST_CLASSES = 32
#: Distinct words of a split, at most about; with the splits they say how many words may be clustered first.
WORDS_A_SPLIT = 100_000
#: What a round of exchange must add to the log likelihood (natural) of a token for another one to follow.
GAIN = 0.3
#: Rounds of the exchange among the first words.
FIRST_ROUNDS = 20
#: Bytes of text in a part, and in a piece of a text.
PART, PIECE = 8 << 20, 1 << 20
TRANSITION, DISCOUNT = 20.0, 0.75
#: Classes are numbered in 16 bits, and twice as many slots of contexts are.
MOST_CLASSES = 1 << 14
_CODE = np.uint16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pack(*arrays, level: int = 3) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), level)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == REMAINDER


def _f(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """What classes add to the likelihood of the training documents; m: class bigrams."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


# ------------------------------------------------ parts
class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pieces(text: bytes):
    """A text, lower-cased, in pieces that end before white space."""
    at = 0
    while len(text) - at > PIECE and (blank := _BLANK.search(text, at + PIECE)):
        yield text[at : blank.start()].lower()
        at = blank.start()
    yield text[at:].lower()


def _runs(words: list[bytes], counts: np.ndarray, bucket: np.ndarray):
    """(bucket, run) of a part's words, in order of buckets and, within one, of words."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        at = order[s:e]
        yield int(bucket[at[0]]), pack(b" ".join([words[i] for i in at]), counts[at])


class Part:
    """Documents as numbers of the part's own words, the most frequent first."""

    def __init__(self):
        self.known, self.docs, self.sizes, self.parts, self.bytes = _Numbers(), [], [], [], 0

    def add(self, doc: int | None, text: bytes) -> None:
        n = 0
        for piece in _pieces(text):
            words = piece.split()
            self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
            n += len(words)
        self.docs.append(doc)
        self.sizes.append(n)
        self.bytes += len(text) + 64

    def rows(self, part: int, buckets: int) -> pa.RecordBatch:
        """The documents in a row without bucket, then a row for each bucket with its words and training counts."""
        ids = np.concatenate(self.parts)
        words = [*self.known]
        order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        ids, words = rank[ids], [words[i] for i in order]
        held = np.array([held_out(d) for d in self.docs], bool)
        counts = np.bincount(ids[~np.repeat(held, self.sizes)], minlength=len(words)).astype(np.uint32)
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        planes = [((ids >> np.uint32(8 * b)) & np.uint32(255)).astype(np.uint8) for b in range(4) if b == 0 or len(words) > 1 << (8 * b)]
        rows = [(part, None, pack(self.docs, np.array(self.sizes, np.int64), held, bucket.astype(np.uint32), planes, level=9))]  # sent in every round
        rows += [(part, b, run) for b, run in _runs(words, counts, bucket)]
        return table_of(rows, ["part", "bucket", "blob"], [pa.int64(), pa.int32(), pa.binary()]).combine_chunks().to_batches()[0]


class Read:
    """A part's documents: symbols with an end (0) after each, and where each word's answer stands."""

    def __init__(self, blob: bytes):
        self.docs, sizes, self.held, self.bucket, planes = unpack(blob)
        ids = sum((p.astype(np.int64) << (8 * b) for b, p in enumerate(planes)), np.zeros(len(planes[0]), np.int64))
        self.sizes = sizes + 1
        ends = np.cumsum(self.sizes) - 1
        self.symbols = np.zeros(int(self.sizes.sum()), np.int64)
        word = np.ones(len(self.symbols), bool)
        word[ends] = False
        self.symbols[word] = ids + 1
        self.order = np.argsort(self.bucket, kind="stable")

    def told(self, answers: dict[int, bytes], first) -> list[np.ndarray]:
        """Answers of the buckets, in the order of the part's words; `first` are those of the end."""
        found = [unpack(answers[b]) for b in sorted(answers)]
        out = []
        for i, end in enumerate(first):
            column = np.concatenate([np.array([end], found[0][i].dtype if found else np.int64), *(x[i] for x in found)])
            placed = np.empty_like(column)
            placed[0], placed[1 + self.order] = column[0], column[1:]
            out.append(placed)
        return out

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols before and at each place of the training documents; an end stands before a document."""
        now = self.symbols[np.repeat(~self.held, self.sizes)]
        # the end before a document is the end of the one before it
        return np.concatenate([[0], now[:-1]]) if len(now) else now, now


def _read_parts(buckets: int):
    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        part = Part()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                part.add(doc, text.as_py() or b"")
                if part.bytes >= PART:
                    yield part.rows(number, buckets)
                    number, part = number + 1, Part()
        if part.docs:
            yield part.rows(number, buckets)

    return run


# ------------------------------------------------ counts
_TALLY = "part long, bucket int, blob binary, word binary, tokens long, id int"


def _tally(top: int):
    """A bucket's words get numbers: for each part the numbers of its words; the counts of all; the most frequent words."""

    def run(key, table):
        b, known, runs = key[0].as_py(), _Numbers(), []
        for part, blob in zip(table["part"].to_pylist(), table["blob"].to_pylist(), strict=True):
            words, n = unpack(blob)
            runs.append((part, np.fromiter(map(known.__getitem__, words.split(b" ")), np.uint32, len(n)), n))
        ids = np.concatenate([r[1] for r in runs])
        # sums of whole numbers, exact below 2^53
        counts = np.bincount(ids, np.concatenate([r[2] for r in runs])).astype(np.int64)
        rows = [(part, b, pack(own), None, None, None) for part, own, _ in runs]
        rows.append((None, b, pack(counts), None, int(counts.sum()), int((counts > 0).sum())))
        least = np.partition(counts, -top)[-top] if len(counts) > top else 1
        best = sorted((-int(counts[i]), w, i) for w, i in known.items() if counts[i] >= max(least, 1))[:top]
        rows += [(None, b, None, w, -n, i) for n, w, i in best]
        return table_of(rows, [x.split()[0] for x in _TALLY.split(", ")], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32()])

    return run


def _summed(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Rows (a, b, n), of which there are few distinct pairs, summed to a matrix."""
    out = np.zeros(shape, np.int64)
    got = df.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(got["a"]), np.asarray(got["b"])] = np.asarray(got["n"])
    return out


def _pairs(counts: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[a, b], pa.int64())], ["a", "b", "n"])


def _count_first(symbols: dict[bytes, int]):
    """Bigrams of the first words, other words (one symbol) and the end. A part's rows stand together, documents first."""
    other = len(symbols)
    n = other + 2

    def run(batches):
        counts, read, words = np.zeros(n * n, np.int64), None, []

        def add():
            if read is not None:
                of = np.full(len(read.order) + 1, other)
                of[0] = n - 1
                of[1 + read.order] = [symbols.get(w, other) for w in words]
                a, b = read.steps()
                np.add(counts, np.bincount(of[a] * n + of[b], minlength=n * n), out=counts)
                words.clear()

        for batch in batches:
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket is None:
                    add()
                    read = Read(blob.as_py())
                else:
                    words += unpack(blob.as_py())[0].split(b" ")
        add()
        yield _pairs(counts.reshape(n, n))

    return run


def exchange(bigrams: np.ndarray, words: int, classes: int, rounds: int = FIRST_ROUNDS) -> np.ndarray:
    """The class of each symbol; the first `words` symbols (most frequent first) move among `classes`, the rest stay
    classes of their own. Maximises sum n(c, d) log n(c, d) - sum n(c) log n(c) over left and right counts."""
    n = len(bigrams)
    classes = min(classes, max(words, 1))
    # the first words open the classes; the others wait in one of their own, which nothing joins
    waiting = classes + n - words
    of = np.concatenate([np.where(np.arange(words) < classes, np.arange(words), waiting), classes + np.arange(n - words)])
    total = waiting + 1
    b = bigrams.astype(float)
    m = np.zeros((total, total))
    np.add.at(m, (of[:, None], of[None, :]), b)
    for _ in range(rounds):
        moved = False
        for w in range(words):
            own, self_ = of[w], b[w, w]
            right = np.bincount(of, b[w], total)
            left = np.bincount(of, b[:, w], total)
            right[own] -= self_
            left[own] -= self_
            m[own] -= right
            m[:, own] -= left
            m[own, own] -= self_
            rows, columns = m.sum(1), m.sum(0)
            k = np.arange(classes)
            base = _f(m)
            gain = (_f(m[:classes] + right) - base[:classes]).sum(1) + (_f(m[:, :classes] + left[:, None]) - base[:, :classes]).sum(0)
            corner = m[k, k]
            gain += _f(corner + right[k] + left[k] + self_) - _f(corner + right[k]) - _f(corner + left[k]) + _f(corner)
            gain -= _f(rows[k] + right.sum() + self_) - _f(rows[k]) + _f(columns[k] + left.sum() + self_) - _f(columns[k])
            best = int(np.argmax(gain))
            if own < classes and gain[best] <= gain[own] + 1e-9:
                best = own
            moved |= best != own
            of[w] = best
            m[best] += right
            m[:, best] += left
            m[best, best] += self_
        if not moved:
            break
    return of


# ------------------------------------------------ exchange over all words
#: Context counts up to which gains come from tables, and entries of such tables; gains weighed at once.
_TABLED, _TABLE = 16, 1 << 24
_WEIGHED = 1 << 22


def place(m: np.ndarray, of: np.ndarray, counts: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray, batch: int = 4096) -> np.ndarray:
    """The best class, 1 or more, of each word that occurs, all others staying where they are.

    Empty classes stay empty. m: class bigrams. word, slot, n: ascending by word, how often class slot stands after it, or class slot - len(m)
    before it. Both sides are weighed as if the other one stood still."""
    k = len(m)
    out = of.copy()
    # into an empty class all words would move at once
    closed = m.sum(0) + m.sum(1) == 0
    closed[0] = True
    tabled = max(1, min(_TABLED, _TABLE // (k * k)))
    x = np.arange(1, tabled + 1)[:, None, None]
    sides = []
    for side in (m, m.T):
        turned = np.ascontiguousarray(side.T.astype(float))  # context, class
        sides.append((turned, (_f(turned + x) - _f(turned)), turned.sum(0)))
    until = np.searchsorted(word, np.arange(len(of) + 1))
    last = 0
    while last < len(of):
        first = last
        # as many words as a batch has, and as few as have entries enough
        last = max(first + 1, min(first + batch, int(np.searchsorted(until, until[first] + _WEIGHED // k, "right")) - 1))
        s, e = until[first], until[min(last, len(of))]
        own = of[first:last]
        i = np.arange(len(own))
        gain = np.zeros((len(own), k))
        for side, (base, table, total) in enumerate(sides):
            mine = (slot[s:e] >= k) == bool(side)
            w, c, v = word[s:e][mine] - first, slot[s:e][mine] - side * k, n[s:e][mine]
            if not len(w):
                continue
            up = table[np.minimum(v, tabled) - 1, c]
            many = np.flatnonzero(v > tabled)
            up[many] = _f(base[c[many]] + v[many, None]) - _f(base[c[many]])
            stays = base[c, own[w]]
            up[np.arange(len(w)), own[w]] = _f(stays) - _f(stays - v)
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[starts]] += np.add.reduceat(up, starts, 0)
            mass = np.bincount(w, v, len(own))
            down = _f(total + mass[:, None]) - _f(total)
            down[i, own] = _f(total[own]) - _f(total[own] - mass)
            gain -= down
        gain[:, closed] = -np.inf
        best = gain.argmax(1)
        better = (counts[first:last] > 0) & (gain[i, best] > gain[i, own] + 1e-9)
        out[first:last] = np.where(better, best, own)
    return out


_STATE = "bucket int, blob binary, class int, words long, tokens long"


def _state_rows(bucket: int, counts: np.ndarray, of: np.ndarray, classes: int) -> pa.Table:
    """A bucket's counts and classes; and how many words and tokens each class has there."""
    rows = [(bucket, pack(counts, of.astype(_CODE)), None, None, None)]
    words, tokens = np.bincount(of[counts > 0], minlength=classes), np.bincount(of, counts, classes)
    rows += [(None, None, k, int(words[k]), int(tokens[k])) for k in range(classes) if words[k]]
    return table_of(rows, [x.split()[0] for x in _STATE.split(", ")], [pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()])


def _start(first: dict[int, list[tuple[int, int]]], classes: int):
    """Classes before the first round: those of the first words (by bucket: number, class), and one for all others."""

    def run(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (counts,) = unpack(blob.as_py())
                of = np.full(len(counts), classes - 1)
                for i, c in first.get(bucket, ()):
                    of[i] = c
                yield from _state_rows(bucket, counts, of, classes).to_batches()

    return run


def _tell(with_counts: bool):
    """To each part, numbers and classes of its words, or classes and counts."""

    def run(key, maps, state):
        counts, of = unpack(state["blob"][0].as_py())
        rows = []
        for part, blob in zip(maps["part"].to_pylist(), maps["blob"].to_pylist(), strict=True):
            (ids,) = unpack(blob)
            rows.append((part, key[0].as_py(), pack(of[ids], counts[ids]) if with_counts else pack(ids, of[ids])))
        return table_of(rows, ["part", "bucket", "blob"], [pa.int64(), pa.int32(), pa.binary()])

    return run


def _told(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["bucket"].to_pylist(), table["blob"].to_pylist(), strict=True))


def _contexts(classes: int):
    """How often each class stands after and before each word of a part, by bucket."""

    def run(key, own, told):
        rows = []
        if told.num_rows:
            read = Read(own["blob"][0].as_py())
            ids, of = read.told(_told(told), (0, 0))
            of = of.astype(np.int64)
            a, b = read.steps()
            found = []
            for side, (at, by) in enumerate(((a, b), (b, a))):
                keys, n = np.unique(at[at > 0] * classes + of[by][at > 0], return_counts=True)  # not those of the end
                found.append((keys // classes, keys % classes + side * classes, n))
            word, slot, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((slot, word, read.bucket[word - 1]))
            word, slot, n = word[order], slot[order].astype(_CODE), n[order].astype(np.uint32)
            bucket = read.bucket[word - 1].astype(np.int64)
            bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                starts = np.flatnonzero(np.diff(word[s:e], prepend=0))
                each = np.diff(starts, append=e - s).astype(_CODE)
                rows.append((int(bucket[s]), pack(ids[word[s:e][starts]].astype(np.uint32), each, slot[s:e], n[s:e])))
        return table_of(rows, ["bucket", "blob"], [pa.int32(), pa.binary()])

    return run


def _merge(classes: int):
    """A bucket's context counts of all parts, with its state; and the class bigrams that its words are the first of."""

    def run(key, table, state):
        slots = 2 * classes
        counts, of = unpack(state["blob"][0].as_py())
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for blob in table["blob"]:
            ids, each, slot, n = unpack(blob.as_py())
            keys.append(np.repeat(ids.astype(np.int64), each) * slots + slot)
            times.append(n)
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")  # runs are sorted
        keys, times = keys[order], times[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.add.reduceat(times.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        word, slot = keys[starts] // slots, keys[starts] % slots
        after = slot < classes
        first = of[word[after]].astype(np.int64)
        once = counts[word[after]] == 1
        # a last row for words seen once, beside that of their class
        pairs = np.concatenate([first * classes + slot[after], classes * classes + slot[after][once]])
        pairs, inverse = np.unique(pairs, return_inverse=True)
        m = np.bincount(inverse, np.concatenate([n[after], n[after][once]]), len(pairs)).astype(np.int64)
        rows = [(key[0].as_py(), pack(counts, of, word.astype(np.uint32), slot.astype(_CODE), n), None, None, None)]
        rows += [(None, None, int(k // classes), int(k % classes), int(v)) for k, v in zip(pairs, m, strict=True)]
        return table_of(rows, ["bucket", "blob", "a", "b", "n"], [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()])

    return run


def _move(m: np.ndarray):
    def run(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts, of, word, slot, n = unpack(blob.as_py())
                to = place(m, of.astype(np.int64), counts, word.astype(np.int64), slot.astype(np.int64), n)
                yield from _state_rows(bucket, counts, to, len(m)).to_batches()

    return run


# ------------------------------------------------ the model
def classes_for(words: int) -> int:
    """Classes of a vocabulary: half its cube root."""
    return min(MOST_CLASSES, max(LEAST_CLASSES, round(max(words, 0) ** (1 / 3) / 2)))


class Model:
    """Parts of a corpus, classes of its words, and what emissions need."""

    def __init__(self, docs: DataFrame, classes: int | None = None, seeds: int | None = None, rounds: int | None = None):
        """classes: by default half the cube root of the vocabulary; seeds: twice that; rounds: as many as gain enough."""
        if classes is not None and not 3 <= classes <= MOST_CLASSES:
            raise ValueError(f"classes must be from 3 to {MOST_CLASSES}")
        buckets = chunk_count(docs)
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.all_parts = parts = cut(own.mapInArrow(_read_parts(buckets), "part long, bucket int, blob binary"))
        self.parts = parts.filter("bucket IS NULL").select("part", "blob")
        # the first words lie about evenly in the buckets, so each tells some more than its share
        most = seeds or max(SEEDS, 2 * classes_for(buckets * WORDS_A_SPLIT))
        tally = cut(parts.filter("bucket IS NOT NULL").groupBy("bucket").applyInArrow(grouped(_tally(min(most, 4 * most // buckets + 64))), _TALLY))
        self.maps = tally.filter("part IS NOT NULL").select("part", "bucket", "blob")
        words, distinct = tally.filter("part IS NULL AND blob IS NOT NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("id"), F.lit(0))).first()
        classes = classes or classes_for(distinct)
        seeds = seeds or max(SEEDS, 2 * classes)
        first = tally.filter("word IS NOT NULL").orderBy(F.desc("tokens"), "word").limit(seeds).collect()
        bigrams = _summed(parts.mapInArrow(_count_first({bytes(r["word"]): i for i, r in enumerate(first)}), "a int, b int, n long"), (len(first) + 2,) * 2)
        ends = int(bigrams[-1].sum())
        self.classes, self.ends = classes, ends
        self.tokens, self.distinct = words + ends, distinct + (ends > 0)
        of = exchange(bigrams, len(first), classes - 2)
        start: dict[int, list[tuple[int, int]]] = {}
        for r, c in zip(first, of.tolist(), strict=False):
            start.setdefault(r["bucket"], []).append((r["id"], c + 1))
        counts = tally.filter("part IS NULL AND blob IS NOT NULL").select("bucket", "blob")
        state = cut(counts.mapInArrow(_start(start, classes), _STATE))
        before, done = None, 0
        while True:
            merged, m = self._counted(state)
            reached = likelihood(m[:-1])
            if before is not None and reached < before[2]:  # all words moved at once, and it was too much
                discard(merged, state)
                state, m, reached = before
                break
            enough = done >= rounds if rounds is not None else before is not None and reached - before[2] <= GAIN * self.tokens
            if before is not None:
                discard(before[0])
            if enough:
                discard(merged)
                break
            before = state, m, reached
            state = cut(merged.filter("blob IS NOT NULL").select("bucket", "blob").mapInArrow(_move(m[:-1]), _STATE))
            discard(merged)
            done += 1
        #: Class bigrams, with a last row for words seen once; and what they add to the likelihood.
        self.m, self.reached = m, reached
        self.use(state)

    def use(self, state: DataFrame) -> None:
        self.state = state.filter("blob IS NOT NULL").select("bucket", "blob")
        self.words_of, self.tokens_of = self._sums(state)

    def _sums(self, state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and tokens of each class."""
        out = np.zeros((2, self.classes))
        for r in state.filter("class IS NOT NULL").groupBy("class").agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).collect():
            out[:, r["class"]] = r["v"], r["n"]
        out[:, 0] = self.ends > 0, self.ends
        return out[0], out[1]

    def told(self, state: DataFrame, with_counts: bool) -> DataFrame:
        return self.maps.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(cogrouped(_tell(with_counts)), "part long, bucket int, blob binary")

    def _counted(self, state: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """Buckets with the contexts of their words (and what their class bigrams are), and the class bigrams."""
        held = state.filter("blob IS NOT NULL").select("bucket", "blob")
        contexts = self.parts.groupBy("part").cogroup(self.told(held, False).groupBy("part")).applyInArrow(cogrouped(_contexts(self.classes)), "bucket int, blob binary")
        merged = cut(contexts.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(cogrouped(_merge(self.classes)), "bucket int, blob binary, a int, b int, n long"))
        m = _summed(merged.filter("a IS NOT NULL").select("a", "b", "n"), (self.classes + 1, self.classes))
        # each token has one before it: what no word is the first of, an end is
        m[0] = self._sums(state)[1].astype(np.int64) - m[1:-1].sum(0)
        return merged, m

    def unknown(self) -> np.ndarray:
        """Each class's probability of a word that no training document has; all of it where a class is empty."""
        e = np.where(self.tokens_of > 0, DISCOUNT * self.words_of / np.maximum(self.tokens_of, 1), 1.0)
        e[0] = 0.0
        return e

    def emission(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words seen `counts` times; 0 for the end and for unknown words."""
        known = (counts > 0) & (classes > 0)
        return np.where(known, np.log10(np.where(known, counts - DISCOUNT, 1.0) / np.where(known, self.tokens_of[classes], 1.0)), 0.0)

    def steps(self, m: np.ndarray) -> np.ndarray:
        """log10 transitions. m: class bigrams, with a last row for words seen once. The last row serves unknown words;
        the last column has the probability of an unknown word."""
        spread = (m[:-1].sum(0) + 1) / (m[:-1].sum() + self.classes)
        t = (m + TRANSITION * spread) / (m.sum(1, keepdims=True) + TRANSITION)
        return np.log10(np.concatenate([t, (t @ self.unknown())[:, None]], 1))


class _Plain:
    """What a task needs of a model."""

    def __init__(self, model: Model):
        self.tokens, self.distinct, self.ends, self.tokens_of = model.tokens, model.distinct, model.ends, model.tokens_of

    emission = Model.emission


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: _Plain, steps: np.ndarray):
    """A part's documents, told the counts and classes of their words."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    classes = len(steps) - 1

    def run(key, own, told):
        read = Read(own["blob"][0].as_py())
        of, counts = (x.astype(np.int64) for x in read.told(_told(told), (0, model.ends)))
        base = np.log10((counts + 1) / (model.tokens + model.distinct + 1))
        emitted = model.emission(of, counts)
        unknown = counts == 0
        unknown[0] = False  # the end is never an unknown word
        symbol = np.where(unknown, classes, of)[read.symbols]
        before = np.concatenate([[0], symbol[:-1]])  # the end before a document is the end of the one before it
        at = np.cumsum(read.sizes) - read.sizes
        total = lambda x: np.add.reduceat(x, at)
        score = total(emitted[read.symbols]) + total(steps[before, symbol])
        columns = [pa.array(read.docs, pa.int64()), pa.array(read.held), pa.array(read.sizes, pa.int64()), pa.array(total((counts > 0).astype(np.int64)[read.symbols])), pa.array(np.full(len(at), model.tokens, np.int64)), pa.array(total(base[read.symbols])), pa.array(score)]
        return pa.Table.from_arrays(columns, names)

    return run


def score(docs: DataFrame, **how) -> DataFrame:
    """Figures and log10 probabilities of every document."""
    model = Model(docs, **how)
    told = model.told(model.state, True)
    return model.parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(cogrouped(_score(_Plain(model), model.steps(model.m.astype(float)))), _OUT)

"""Suffix-array dedup: a common-prefix-aware distributed merge sort over sparse suffixes.

A byte goes if a 100-byte string that also starts earlier covers it (earlier: smaller doc_id, or same document and
smaller offset; matches never cross documents; strings are judged on the input). Sorting every suffix would move a
hundred times the input, so only anchored suffixes are sorted: in each 100-byte window the 37-byte gram with the least
hash is its anchor. Equal windows have equal anchors at equal offsets, hence nothing is lost.

1. Each chunk sends its distinct anchor hashes, sorted, and how many different surroundings each has; buckets answer
   which of them stand more than once.
2. For those, chunks sort the suffixes that start at the anchors, each as far as its windows reach (with the bytes to
   the left that its windows cover), keep the earliest of equal ones, and send front-coded sorted runs.
   A hot anchor, one with very many different surroundings (a passage in a third of all documents, at its edges), would
   bring all of them to one bucket. Its windows go into the same runs one by one, each as a string of its own that
   starts where the window does, so buckets are chosen by whole windows and the sort is split there.
3. Buckets combine the runs with a loser tree that carries longest common prefixes and never compares known ones again;
   the prefix lengths then tell for each offset which windows are equal, and all but the earliest are repeats.
4. Chunks join the repeated stretches of their documents and cut them out.

A null text counts as empty. Null ids come before all others, and rows without id are ordered by a digest of their text,
wherever they are; rows with one id lie in one chunk and are ordered by text. Equal rows count as one after the other.
Texts of fewer than 100 bytes lose nothing, long ones are hashed piece by piece, and an empty table gives an empty
result. Every byte of every document takes part. Columns of any names are kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Texts, bucket_of, chunked, cogrouped, from_six, grouped, mix64, pack, six_bytes, slices, table_of, unpack

WINDOW = 100
GRAM = 37
SPAN = WINDOW - GRAM + 1  # grams in a window; a power of two
#: A hot anchor has so many different surroundings, and four times as many as chunks that have it.
HOT = 512
#: Bytes that are hashed at a time.
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 5, 8, 16)}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Odd 64-bit hash of the 37 bytes from each position, by doubling lengths."""
    h = data.astype(np.uint64) + np.uint64(1)
    one, size = h, 1
    four = None
    while size < 32:
        h = h[:-size] * _POWER[size] + h[size:]
        size *= 2
        four = h if size == 4 else four
    # 32 + 4 + 1
    n = len(data) - GRAM + 1
    h = h[:n] * _POWER[5] + four[32 : 32 + n] * _POWER[1] + one[36 : 36 + n]
    return mix64(h) | np.uint64(1)


def _sliding(a: np.ndarray, pick, span: int = SPAN) -> np.ndarray:
    size = 1
    while size < span:
        a = pick(a[:-size], a[size:])
        size *= 2
    return a


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, anchor positions, and the nearest and farthest start, before each anchor, of the windows it stands for.

    starts: the documents' bounds in data, the end included."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    least = _sliding(h, np.minimum)
    room = np.repeat(starts[1:], np.diff(starts))[: len(least)] - np.arange(len(least))
    least[room < WINDOW] = 0
    edge = np.zeros(SPAN - 1, np.uint64)
    top = _sliding(np.concatenate([edge, least, edge]), np.maximum)
    at = np.flatnonzero(top == h)
    window = at[:, None] - np.arange(SPAN)
    own = (window >= 0) & (window < len(least))
    own &= least[np.clip(window, 0, len(least) - 1)] == h[at][:, None]
    return h, at, own.argmax(1).astype(np.uint8), (SPAN - 1 - own[:, ::-1].argmax(1)).astype(np.uint8)


def _surroundings(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tells apart the text around anchors, well enough to count its variants."""
    out = np.zeros(len(at), np.uint64)
    for i, d in enumerate((-SPAN + 1, -GRAM, GRAM, WINDOW - GRAM)):
        there = at + d
        ok = (there >= 0) & (there < len(h))
        out += np.where(ok, h[np.clip(there, 0, len(h) - 1)], 0) * np.uint64(2 * i + 3)
    return out


def _segments(texts: Texts):
    """(first byte, bounds) of stretches of whole documents; a long document comes in stretches that overlap by a window."""
    for first, last in texts.batches(SEGMENT):
        at = texts.at[first : last + 1]
        if last - first > 1 or at[-1] - at[0] <= 2 * SEGMENT:
            yield int(at[0]), at - at[0]
            continue
        for s in range(int(at[0]), int(at[-1]) - WINDOW + 1, SEGMENT):
            yield s, np.array([0, min(SEGMENT + WINDOW - 1, int(at[-1]) - s)])


def _all_anchors(texts: Texts):
    for base, starts in _segments(texts):
        h, *found = anchors(texts.data[base : base + int(starts[-1])], starts)
        yield base, h, *found


def _names(h: np.ndarray) -> np.ndarray:
    """48-bit names of anchors. Anchors have small hashes, being least of their windows; another mixing spreads them."""
    return mix64(h * np.uint64(_BASE)) >> np.uint64(16)


def _announce(buckets: int):
    """Step 1: a chunk's distinct anchors by bucket."""

    def run(key, table):
        texts = Texts(table)
        found = [(_names(h[at]), _surroundings(h, at)) for _, h, at, _, _ in _all_anchors(texts)]
        rows = []
        if found:
            v = np.concatenate([x[0] for x in found])
            around = np.concatenate([x[1] for x in found])
            order = np.lexsort((around, v))
            v, around = v[order], around[order]
            new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
            variant = new.copy()
            variant[1:] |= around[1:] != around[:-1]
            which = np.cumsum(new) - 1
            variants = np.minimum(np.bincount(which, variant, new.sum()), 255).astype(np.uint8)
            twice = np.bincount(which, minlength=new.sum()) > 1
            v = v[new]
            for b, s, e in slices(v, buckets):
                rows.append((b, key[0].as_py(), pack(six_bytes(v[s:e]), variants[s:e], np.packbits(twice[s:e]))))
        return table_of(rows, ["bucket", "chunk", "run"], [pa.int32(), pa.int32(), pa.binary()])

    return run


def _answer(key, table):
    """Step 1, answers: for each entry of each chunk 0 (stands once), 1 (repeated) or 2 (repeated, very many variants)."""
    runs = [unpack(x) for x in table["run"].to_pylist()]
    chunks = table["chunk"].to_pylist()
    vs = [from_six(r[0]) for r in runs]
    v = np.concatenate(vs)
    order = np.argsort(v, kind="stable")
    s = v[order]
    which = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
    variants = np.bincount(which, np.concatenate([r[1] for r in runs])[order])
    holders = np.bincount(which)
    twice = np.concatenate([np.unpackbits(r[2], count=len(x)) for r, x in zip(runs, vs, strict=True)])[order]
    repeated = (holders > 1) | (np.bincount(which, twice) > 0)
    flag = np.where(repeated, np.where((variants >= HOT) & (variants >= 4 * holders), 2, 1), 0).astype(np.uint8)
    flags = np.empty(len(v), np.uint8)
    flags[order] = flag[which]
    rows, at = [], 0
    for chunk, x in zip(chunks, vs, strict=True):
        own = flags[at : at + len(x)]
        at += len(x)
        if own.any():
            rows.append((chunk, key[0].as_py(), pack(own)))
    return table_of(rows, ["chunk", "bucket", "flags"], [pa.int32(), pa.int32(), pa.binary()])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that `known` bytes agree."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differing = (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()
    return n - (differing + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Sorted strings as the lengths shared with the one before, own lengths, and what is left."""
    shared, last, rest = np.zeros(len(strings), np.uint8), b"", []
    for i, s in enumerate(strings):
        shared[i] = k = common_prefix(last, s)
        rest.append(s[k:])
        last = s
    return b"".join(rest), shared, np.array([len(s) for s in strings], np.uint8)


def decode(rest: bytes, shared: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of all strings as (run, place), and each one's prefix shared with the one before.

    runs: sorted strings, and their prefixes shared within the run. A loser tree: a node holds the run that lost there
    and the length it shares with the winner. Against the last string put out, the longer shared prefix is the lesser
    string; only equal lengths need a comparison, and it starts behind them."""
    k = len(runs)
    if not k:
        return [], []
    width = 1 << (k - 1).bit_length()
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (width - k)
    lcp, place, losers = [0] * width, [0] * width, [0] * width

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        n = common_prefix(x, y, lcp[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            lcp[b] = n
            return True
        lcp[a] = n
        return False

    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            if not beats(a, b):
                a, b = b, a
            losers[level + i] = b
            nxt.append(a)
        winners = nxt
    w = winners[0]
    order, shared = [], []
    while heads[w] is not None:
        order.append((w, place[w]))
        shared.append(lcp[w])
        strings, prefixes = runs[w]
        place[w] = p = place[w] + 1
        if p < len(strings):
            heads[w], lcp[w] = strings[p], prefixes[p]
        else:
            heads[w], lcp[w] = None, 0
        node = (w + width) // 2
        while node:
            if not beats(w, losers[node]):
                w, losers[node] = losers[node], w
            node //= 2
    return order, shared


def _send_runs(buckets: int):
    """Step 2: front-coded runs of suffixes at repeated anchors; what is repeated inside the chunk is known already."""

    def run(key, docs, answers):
        chunk = key[0].as_py()
        names, kinds = ["bucket", "known", "chunk", "run"], [pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
        if not docs.num_rows or not answers.num_rows:
            return table_of([], names, kinds)
        texts = Texts(docs)
        found = [(at + base, _names(h[at]), low, high) for base, h, at, low, high in _all_anchors(texts)]
        v = np.unique(np.concatenate([x[1] for x in found]))
        flags = np.zeros(len(v), np.uint8)
        told = dict(zip(answers["bucket"].to_pylist(), answers["flags"].to_pylist(), strict=True))
        for b, s, e in slices(v, buckets):
            if b in told:
                flags[s:e] = unpack(told[b])[0]
        first: set[tuple] = set()
        windows: dict[bytes, tuple[int, int]] = {}
        keys, rights, lefts, docs_at, starts, reach = [], [], [], [], [], []
        own: list[tuple[int, int, int]] = []
        memory = texts.memory
        for at, name, low, high in found:
            flag = flags[np.searchsorted(v, name)]
            known = np.flatnonzero(flag)
            doc = np.searchsorted(texts.at, at[known], "right") - 1
            for p, d, lo, hi, f, k in zip(at[known].tolist(), doc.tolist(), low[known].tolist(), high[known].tolist(), flag[known].tolist(), name[known].tolist(), strict=True):
                start = int(texts.at[d])
                whole = bytes(memory[p - hi : p - lo + WINDOW])
                mark = (whole, lo, hi)
                if mark in first:
                    own.append((d, p - hi - start, p - lo + WINDOW - start))
                    continue
                first.add(mark)
                if f == 1:
                    keys.append(k)
                    rights.append(whole[hi:])
                    lefts.append(whole[:hi])
                    docs_at.append(d)
                    starts.append(p - start)
                    reach.append((lo, hi))
                    continue
                for o in range(hi, lo - 1, -1):
                    window = whole[hi - o : hi - o + WINDOW]
                    if window in windows:  # unless another anchor of the same window brought it
                        if windows[window] != (d, p - o):
                            own.append((d, p - o - start, p - o + WINDOW - start))
                        continue
                    windows[window] = (d, p - o)
                    keys.append(int.from_bytes(hashlib.blake2b(window, digest_size=6).digest()))
                    rights.append(window)
                    lefts.append(b"")
                    docs_at.append(d)
                    starts.append(p - o - start)
                    reach.append((0, 0))
        rows = []
        ids, ties = texts.id_or_least, texts.ties
        if keys:
            bucket = bucket_of(np.array(keys, np.uint64), buckets).astype(np.int64)
            order = sorted(range(len(keys)), key=lambda i: (bucket[i], rights[i]))
            bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for s, e in zip(bounds, [*bounds[1:], len(order)], strict=True):
                part = order[s:e]
                rest, shared, sizes = front_code([rights[i] for i in part])
                d = np.array([docs_at[i] for i in part], np.int32)
                blob = pack(rest, shared, sizes, b"".join(lefts[i] for i in part), np.array([reach[i] for i in part], np.uint8), ids[d], d, np.array([starts[i] for i in part], np.int32), ties[d] if ties is not None else None)
                rows.append((int(bucket[part[0]]), False, chunk, blob))
        if own:
            rows.append((chunk % buckets, True, chunk, pack(np.array(own, np.int32))))
        return table_of(rows, names, kinds)

    return run


def _repeats(runs: list[tuple]) -> list[np.ndarray]:
    """For each front-coded run: rows (document, start, end) of stretches whose windows all stand earlier."""
    decoded = [(decode(r[0], r[1], r[2]), r[1].tolist()) for r in runs]
    order, shared = merge_runs(decoded)
    n = len(order)
    of = np.array([o[0] for o in order])
    place = np.array([o[1] for o in order])
    firsts = np.cumsum([0] + [len(r[2]) for r in runs])
    flat = firsts[of] + place
    reach = np.concatenate([r[4] for r in runs])[flat].astype(np.int64)
    ids, doc, at = (np.concatenate([r[i] for r in runs])[flat] for i in (5, 6, 7))
    tie = np.concatenate([r[8] if r[8] is not None else np.zeros(len(r[5]), np.uint64) for r in runs])[flat]
    low, high = reach[:, 0], reach[:, 1]
    lefts: list[bytes] = []
    for r in runs:
        ends = np.cumsum(r[4][:, 1].astype(np.int64)).tolist()
        lefts += [r[3][s:e][::-1] for s, e in zip([0, *ends], ends, strict=False)]
    left = [lefts[i] for i in flat.tolist()]
    by_left = np.array(sorted(range(n), key=left.__getitem__))
    padded = np.frombuffer(b"".join(left[i].ljust(SPAN, b"\0") for i in by_left.tolist()), np.uint8).reshape(n, SPAN)
    agree = (padded[1:] == padded[:-1]).cumprod(1).sum(1) if n > 1 else np.zeros(0, np.int64)
    left_lcp = np.concatenate([[0], np.minimum(agree, np.minimum(high[by_left][1:], high[by_left][:-1]))])
    shared_ = np.array(shared)
    rank = np.lexsort((at, doc, tie, ids))
    least, most = np.full(n, SPAN), np.full(n, -1)
    class_of = np.empty(n, np.int64)
    for o in range(SPAN):
        takes = rank[(low[rank] <= o) & (o <= high[rank])]
        if len(takes) < 2:
            continue
        block = np.cumsum(shared_ < WINDOW - o)
        class_of[by_left] = np.cumsum(left_lcp < o)
        again = takes[pd.Series((block * (n + 1) + class_of)[takes]).duplicated().to_numpy()]
        least[again] = np.minimum(least[again], o)
        most[again] = np.maximum(most[again], o)
    hit = most >= 0
    out = np.stack([doc, at - most, at - least + WINDOW], 1)[hit].astype(np.int32)
    return [out[of[hit] == i] for i in range(len(runs))]


def _combine(key, table):
    """Step 3: the repeated stretches of each chunk's documents."""
    rows = []
    known, chunks, blobs = (table[c].to_pylist() for c in ("known", "chunk", "run"))
    runs = [i for i, done in enumerate(known) if not done]
    if runs:
        for i, found in zip(runs, _repeats([unpack(blobs[i]) for i in runs]), strict=True):
            if len(found):
                rows.append((chunks[i], pack(found)))
    rows += [(chunks[i], blobs[i]) for i, done in enumerate(known) if done]
    return table_of(rows, ["chunk", "stretches"], [pa.int32(), pa.binary()])


def _cut(texts: Texts, stretches: np.ndarray):
    """(removed bytes, spans, remaining bytes) of each document."""
    order = np.argsort(stretches[:, 0], kind="stable") if len(stretches) else np.zeros(0, int)
    by_doc = stretches[order]
    bounds = np.searchsorted(by_doc[:, 0], np.arange(texts.n + 1)) if len(by_doc) else np.zeros(texts.n + 1, int)
    for i in range(texts.n):
        own = by_doc[bounds[i] : bounds[i + 1]]
        if not len(own):
            yield 0, 0, texts.bytes_of(i)
            continue
        data = texts.data[int(texts.at[i]) : int(texts.at[i + 1])]
        depth = np.bincount(own[:, 1], minlength=len(data) + 1) - np.bincount(own[:, 2], minlength=len(data) + 1)
        gone = np.cumsum(depth)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        yield int(gone.sum()), spans, data[~gone].tobytes()


def _repeated(docs: DataFrame, chunks: int) -> DataFrame:
    """chunk, stretches: what is to be cut out; docs: chunk, doc_id, text."""
    told = docs.groupBy("chunk").applyInArrow(grouped(_announce(chunks)), "bucket int, chunk int, run binary").groupBy("bucket").applyInArrow(grouped(_answer), "chunk int, bucket int, flags binary")
    runs = docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cogrouped(_send_runs(chunks)), "bucket int, known boolean, chunk int, run binary")
    return runs.groupBy("bucket").applyInArrow(grouped(_combine), "chunk int, stretches binary")


def _stretches(table: pa.Table) -> np.ndarray:
    found = [unpack(x)[0] for x in table["stretches"].to_pylist()]
    return np.concatenate(found) if found else np.zeros((0, 3), np.int32)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row."""
    dealt, chunks = chunked(docs)

    def run(key, own, found):
        texts = Texts(own)
        rows = [(i, len(kept) + n, n, spans, hashlib.sha256(kept).hexdigest()) for i, (n, spans, kept) in zip(texts.ids.to_pylist(), _cut(texts, _stretches(found)), strict=True)]
        return table_of(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()])

    return dealt.groupBy("chunk").cogroup(_repeated(dealt, chunks).groupBy("chunk")).applyInArrow(cogrouped(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without repeated passages, in their own columns. A character that lost some of its bytes goes whole; a
    document that had text and lost all of it goes too; a column n_chars is set anew."""
    own, kept_columns = docs.columns, [c for c in docs.columns if c not in ("doc_id", "text")]
    dealt, chunks = chunked(docs, kept_columns)
    schema = dealt.select("doc_id", "text", "row").schema

    def run(key, left, found):
        texts = Texts(left)
        out: list[str | None] = []
        keep = []
        for was, (n, _, kept) in zip(texts.table["text"], _cut(texts, _stretches(found)), strict=True):
            out.append(kept.decode("utf8", "ignore") if n else was.as_py())
            keep.append(not n or bool(out[-1]))
        done = pa.table({"doc_id": texts.table["doc_id"], "text": pa.array(out, pa.string()), "row": texts.table["row"]})
        return done.filter(pa.array(keep, pa.bool_()))

    done = dealt.groupBy("chunk").cogroup(_repeated(dealt, chunks).groupBy("chunk")).applyInArrow(cogrouped(run), schema)
    result = {c: F.col(f"row.c{i}") for i, c in enumerate(kept_columns)} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    if "n_chars" in result:
        result["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*(result[c].alias(c) for c in own))

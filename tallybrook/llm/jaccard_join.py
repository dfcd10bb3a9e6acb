"""N-gram Jaccard join: signature trees over candidates that share a rare shingle.

Documents are sets of 64-bit hashes of word shingles. Two link when 100 |x & y| >= percent |x | y|.
1. Chunks send their distinct shingles (sorted, delta-coded) once each; buckets answer in how many sets each stands.
   Equal sets are found on the way: only the one with the smallest doc_id goes on.
2. A set whose shingles are too seldom shared to reach the threshold has no partner. For the others, shingles are ordered
   rarest first; two linked sets must share one among the first |x| - ceil(t |x|) + 1 of each, so sets are grouped by
   the components of these shared shingles. No pairs are made here; a shingle in a third of all documents adds one
   entry a chunk.
3. Within a group, a signature tree holds OR-combined token bitmaps and size ranges; two nodes are compared with each
   other from the root down and dropped as soon as the largest overlap that the bitmaps allow is too small. The pairs
   of sets that are left are compared exactly. Groups are split by classes of size, and these into blocks; a block meets
   the blocks of its own class and the next ones, since linked sets are no further apart. A task's memory is bounded
   whatever the size of the group, and no partner is cut off.
4. The links' components give each document the smallest doc_id it reaches; n_links counts the other documents it links
   with directly, copies included.

A text without words (or null) has an empty set and links with nothing; with fewer words than a shingle takes, the whole
sequence is one shingle. Rows that share a doc_id count as linked; rows without one take part in nothing and get a null
component. Repeated rows each get their row; texts are hashed whole, however long; link_documents reads no other columns,
and keep_one keeps them under any names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Texts, chunked, cogrouped, from_six, grouped, mix64, pack, six_bytes, table_of, unpack
from .common import cut, unpacked, whole_row
from .components import components

WORDS = 5
PERCENT = 75
#: Sets in a block of a group.
BLOCK = 128
BITS = 2048
LEAF = 8

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))
_LETTER[65:91] = _LETTER[97:123]
_RADIX = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lower-cased, and the number of words of each document."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    bounds = at[:-1][at[:-1] < len(data)]
    first[bounds] = word[bounds]
    starts = np.flatnonzero(first)
    n = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return np.zeros(0, np.uint64), n
    lengths = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    part = np.where(word[starts[0] :], _LETTER[data[starts[0] :]] * _powers(_RADIX, int(lengths.max()))[place], 0)
    return mix64(np.add.reduceat(part, starts - starts[0])), n


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and the size of each document's set."""
    h, n = word_hashes(data, at)
    docs = len(n)
    sizes = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(docs), sizes)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends - n, sizes)
    weight = _powers(_RADIX ^ 0x5555, words + 1)
    s = np.zeros(len(doc), np.uint64)
    for j in range(words):
        there = begin + j
        ok = there < ends[doc]
        s += np.where(ok, h[np.minimum(there, len(h) - 1)] | np.uint64(1), 0) * weight[j + 1]
    s = mix64(s)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=docs)


class Sets:
    """The shingle sets of a chunk and, of equal ones, the first."""

    def __init__(self, texts: Texts, words: int):
        parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, last in texts.batches():
            base = int(texts.at[first])
            s, n = shingle_sets(texts.data[base : int(texts.at[last])], texts.at[first : last + 1] - base, words)
            parts.append(s)
            sizes.append(n)
        self.hashes, self.sizes = np.concatenate(parts), np.concatenate(sizes)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        named = texts.ids.is_valid().to_numpy(zero_copy_only=False) if texts.n else np.zeros(0, bool)
        self.ids = texts.id_or_least
        whole = np.flatnonzero((self.sizes > 0) & named)
        sums = np.add.reduceat(mix64(self.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.at[:-1][self.sizes > 0]) if len(self.hashes) else np.zeros(0, np.uint64)
        name = np.zeros(texts.n, np.uint64)
        name[self.sizes > 0] = mix64(sums + self.sizes[self.sizes > 0].astype(np.uint64))
        #: Names of the distinct sets, ascending; the first document (documents are in order of id) with each.
        self.names, at = np.unique(name[whole], return_index=True)
        self.firsts = whole[at]
        self.which = np.full(texts.n, -1)
        self.which[whole] = np.searchsorted(self.names, name[whole])

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.at[i] : self.at[i + 1]]

    def distinct(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles, cut to their upper bits, of the distinct sets; in how many of them each stands."""
        if not len(self.firsts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.unique(np.concatenate([self.of(i) for i in self.firsts]) >> np.uint64(64 - bits), return_counts=True)


def key_bits(chunks: int) -> int:
    """Bits of a shingle's hash that are exchanged: enough that few distinct ones fall together, at any size."""
    return min(64, 34 + max(1, chunks - 1).bit_length())


def _bounds(v: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket of the sorted keys v begins; one more for the end."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(v, edges), len(v))


def _planes(v: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane."""
    d = np.diff(v, prepend=np.uint64(0))
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _announce(chunks: int, words: int):
    bits = key_bits(chunks)

    def run(key, table):
        sets = Sets(Texts(table), words)
        v, n = sets.distinct(bits)
        at, names = _bounds(v, bits, chunks), _bounds(sets.names, 64, chunks)
        first_id = sets.ids[sets.firsts]
        rows = []
        for b in range(chunks):
            s, e, s2, e2 = at[b], at[b + 1], names[b], names[b + 1]
            if e > s or e2 > s2:
                rows.append((b, key[0].as_py(), pack(_planes(v[s:e]), np.minimum(n[s:e], 65535).astype(np.uint16), sets.names[s2:e2], first_id[s2:e2])))
        return table_of(rows, ["bucket", "chunk", "run"], [pa.int32(), pa.int32(), pa.binary()])

    return run


def _answer(key, table):
    """In how many sets each shingle stands (as a power of two), and the first document with each set."""
    runs = [unpack(x) for x in table["run"].to_pylist()]
    vs = [_from_planes(r[0]) for r in runs]
    v = np.concatenate(vs)
    order = np.argsort(v, kind="stable")
    s = v[order]
    group = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
    total = np.bincount(group, np.concatenate([r[1] for r in runs])[order]) if len(s) else np.zeros(0)
    level = np.empty(len(v), np.uint8)
    level[order] = np.minimum(np.ceil(np.log2(np.maximum(total, 1))), 250).astype(np.uint8)[group] if len(s) else 0
    names, which = np.unique(np.concatenate([r[2] for r in runs]), return_inverse=True)
    least = np.full(len(names), 2**63 - 1, np.int64)
    np.minimum.at(least, which, np.concatenate([r[3] for r in runs]))
    rows, at, at2 = [], 0, 0
    for chunk, x, r in zip(table["chunk"].to_pylist(), vs, runs, strict=True):
        rows.append((chunk, key[0].as_py(), pack(level[at : at + len(x)], least[which[at2 : at2 + len(r[2])]])))
        at, at2 = at + len(x), at2 + len(r[2])
    return table_of(rows, ["chunk", "bucket", "told"], [pa.int32(), pa.int32(), pa.binary()])


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


_ROW = "kind int, doc_id long, n long, owner long, blob binary"
MEMBER, SET, KEYS, LINK = range(4)


def _select(chunks: int, words: int, percent: int):
    """Rows of four kinds: each document with the owner of its set; sets that may have a partner; their keys by bucket
    (in `n`); and links inside the chunk that keys make."""
    bits = key_bits(chunks)

    def run(key, docs, answers):
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        texts = Texts(docs)
        sets = Sets(texts, words)
        v, _ = sets.distinct(bits)
        at, names = _bounds(v, bits, chunks), _bounds(sets.names, 64, chunks)
        level, owner = np.zeros(len(v), np.uint8), np.zeros(len(sets.names), np.int64)
        for b, told in zip(answers["bucket"].to_pylist(), answers["told"].to_pylist(), strict=True):
            levels, least = unpack(told)
            level[at[b] : at[b + 1]], owner[names[b] : names[b + 1]] = levels, least
        rows = []
        for i, (doc, n) in enumerate(zip(texts.ids.to_pylist(), sets.sizes.tolist(), strict=True)):
            rows.append((MEMBER, doc, n, int(owner[sets.which[i]]) if sets.which[i] >= 0 else doc, None))
        forest, holders = Forest(), {}
        for j, i in enumerate(sets.firsts.tolist()):
            doc, own = int(sets.ids[i]), sets.of(i)
            if owner[j] != doc:
                continue
            n = len(own)
            need = -(-n * percent // 100)
            cut_ = own >> np.uint64(64 - bits)
            common = level[np.searchsorted(v, cut_)]
            if int((common > 0).sum()) < need:
                continue
            prefix = np.lexsort((cut_, common))[: n - need + 1]
            keys = cut_[prefix][common[prefix] > 0].tolist()
            rows.append((SET, doc, n, doc, six_bytes(np.unique(own >> np.uint64(16)))))
            for k in keys:
                if (other := holders.setdefault(k, doc)) != doc:
                    forest.join(other, doc)
        rows += [(LINK, a, 0, b, None) for a, b in forest.links()]
        held = sorted(holders)
        if held:
            k = np.array(held, np.uint64)
            root = np.array([forest.find(holders[x]) for x in held], np.int64)
            ends = _bounds(k, bits, chunks)
            rows += [(KEYS, None, b, None, pack(_planes(k[ends[b] : ends[b + 1]]), root[ends[b] : ends[b + 1]])) for b in range(chunks) if ends[b + 1] > ends[b]]
        return table_of(rows, ["kind", "doc_id", "n", "owner", "blob"], kinds)

    return run


def _meet(key, table):
    """Links of sets that hold the same key."""
    runs = [unpack(x) for x in table["blob"].to_pylist()]
    k, root = np.concatenate([_from_planes(r[0]) for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.lexsort((root, k))
    k, root = k[order], root[order]
    same = k[1:] == k[:-1]
    pairs = np.unique(np.stack([root[1:][same], root[:-1][same]], 1), axis=0)
    forest = Forest()
    for a, b in pairs.tolist():
        forest.join(a, b)
    return table_of(forest.links(), ["a", "b"], [pa.int64(), pa.int64()])


class Tree:
    """A signature tree: at each level OR-combined bitmaps, size ranges, and how many tokens share a bit at most."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(sizes, kind="stable")
        self.ids = [ids[i] for i in order]
        self.arrays = [sets[i] for i in order]
        self._sets: list[frozenset] | None = None
        sizes = sizes[order]
        bits = np.zeros((len(order), BITS), bool)
        bits[np.repeat(np.arange(len(order)), sizes), np.concatenate([sets[i] for i in order]) % np.uint64(BITS)] = True
        bitmap = np.packbits(bits, axis=1).view(np.uint64)
        self.levels = [(bitmap, sizes, sizes, sizes - bits.sum(1))]
        while len(self.levels[-1][1]) > 1 or len(self.levels) < 2:
            bitmap, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    @property
    def sets(self) -> list[frozenset]:
        if self._sets is None:
            self._sets = [frozenset(s.tolist()) for s in self.arrays]
        return self._sets

    def reaching(self, level: int, rows: slice, other: Tree, level2: int, columns: slice, percent: int) -> np.ndarray:
        """Pairs of nodes whose sets may link: sizes near enough, and enough common bits."""
        b, low, high, slack = (x[rows] for x in self.levels[level])
        b2, low2, high2, slack2 = (x[columns] for x in other.levels[level2])
        near = (100 * high[:, None] >= percent * low2) & (100 * high2 >= percent * low[:, None])
        most = np.bitwise_count(b[:, None] & b2[None]).sum(2, dtype=np.int64) + np.minimum(slack[:, None], slack2)
        return near & ((100 + percent) * most >= percent * (low[:, None] + low2))


def candidates(x: Tree, y: Tree, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets (by place) of two trees, or within one, that the bounds don't rule out: both are traversed from their roots."""
    out = []
    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        i, a, j, b = todo.pop()
        # the children of a node at level i are rows of level i - 1; a leaf's children are sets
        down, down2 = (i - 1, j - 1) if i == j else (i - 1, j) if i > j else (i, j - 1)
        rows = slice(a * LEAF, (a + 1) * LEAF) if down < i else slice(a, a + 1)
        columns = slice(b * LEAF, (b + 1) * LEAF) if down2 < j else slice(b, b + 1)
        for p, q in np.argwhere(x.reaching(down, rows, y, down2, columns, percent)).tolist():
            p, q = rows.start + p, columns.start + q
            if x is y and p > q:
                continue
            if down or down2:
                todo.append((down, p, down2, q))
            elif x is not y or p < q:
                out.append((p, q))
    return out


def overlaps(x: Tree, y: Tree) -> np.ndarray:
    """Sizes of all intersections between two blocks, by products of 0/1 matrices over the shingles that several sets hold."""
    both = [x] if x is y else [x, y]
    flat = np.concatenate([s for t in both for s in t.arrays])
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[which]
    owner = np.repeat(np.arange(sum(len(t.ids) for t in both)), [len(s) for t in both for s in t.arrays])
    total = np.zeros((len(x.ids), len(y.ids)), np.int64)
    first = 0 if x is y else len(x.ids)
    for start in range(0, int((times > 1).sum()), 8192):
        mine = (column >= start) & (column < start + 8192)
        m = np.zeros((int(owner[-1]) + 1, 8192), np.float32)
        m[owner[mine], column[mine] - start] = 1
        total += (m[: len(x.ids)] @ m[first:].T).astype(np.int64)
    return total


def links_between(x: Tree, y: Tree, percent: int) -> list[tuple[int, int]]:
    """Places of all linked pairs."""
    pairs = candidates(x, y, percent)
    if not pairs:
        return []
    p, q = np.array(pairs).T
    n, m = np.array([len(s) for s in x.arrays])[p], np.array([len(s) for s in y.arrays])[q]
    # a few pairs are cheaper one by one, and many as a product
    both = overlaps(x, y)[p, q] if len(pairs) > 500 else np.array([len(x.sets[i] & y.sets[j]) for i, j in pairs])
    return [pairs[i] for i in np.flatnonzero(100 * both >= percent * (n + m - both))]


def _join_cells(percent: int):
    """Rows of two kinds: links that span what is connected, and each set's number of partners, copies included."""

    def run(key, table):
        cells: dict[tuple, tuple[list, list]] = {}
        columns = (table[c].to_pylist() for c in ("component", "i", "j", "side", "doc_id", "copies", "blob"))
        for component, i, j, side, doc, copies, blob in zip(*columns, strict=True):
            cells.setdefault((component, i, j), ([], []))[side].append((doc, copies, blob))
        rows: list[tuple[int, int, int]] = []
        for left, right in cells.values():
            if not left or (len(left) == 1 and not right):
                continue
            copies = {d: c for part in (left, right) for d, c, _ in part}
            x = Tree([d for d, _, _ in left], [from_six(s) for _, _, s in left])
            y = Tree([d for d, _, _ in right], [from_six(s) for _, _, s in right]) if right else x
            forest, partners = Forest(), dict.fromkeys(copies, 0)
            for p, q in links_between(x, y, percent):
                a, b = x.ids[p], y.ids[q]
                forest.join(a, b)
                partners[a] += copies[b]
                partners[b] += copies[a]
            rows += [(0, a, b) for a, b in forest.links()] + [(1, d, n) for d, n in partners.items() if n]
        return table_of(rows, ["kind", "a", "b"], [pa.int32(), pa.int64(), pa.int64()])

    return run


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for every row."""
    dealt, chunks = chunked(docs)
    told = dealt.groupBy("chunk").applyInArrow(grouped(_announce(chunks, words)), "bucket int, chunk int, run binary").groupBy("bucket").applyInArrow(grouped(_answer), "chunk int, bucket int, told binary")
    found = cut(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cogrouped(_select(chunks, words, percent)), _ROW))
    met = found.filter(F.col("kind") == KEYS).select(F.col("n").alias("bucket"), "blob").groupBy("bucket").applyInArrow(grouped(_meet), "a long, b long")
    inside = found.filter(F.col("kind") == LINK).select(F.col("doc_id").alias("a"), F.col("owner").alias("b"))
    group = components(met.union(inside)).withColumnRenamed("node", "doc_id")
    members = found.filter(F.col("kind") == MEMBER).select("doc_id", F.col("n").alias("n_shingles"), "owner")
    copies = cut(members.filter("n_shingles > 0 AND owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("copies")))
    # linked sets differ in size by at most a class, so a set only meets its own class and the next ones
    step = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    of_size = F.floor(F.log("n") / F.lit(step)).cast("int").alias("class")
    sets = found.filter(F.col("kind") == SET).select("doc_id", of_size, "blob")
    light = cut(sets.select("doc_id", "class").distinct().join(group, "doc_id"))
    held = light.groupBy("component", "class").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("component")))
    # groups that fit a block are one
    whole, blocks = F.col("all") <= block, F.ceil(F.col("n") / block).cast("int")
    near = F.collect_list(F.struct("class", blocks.alias("blocks"))).over(Window.partitionBy("component").orderBy("class").rangeBetween(-1, 1))
    one = F.array(F.struct(F.lit(-1).alias("class"), F.lit(1).alias("blocks")))
    held = held.select("component", "class", F.when(whole, -1).otherwise(F.col("class")).alias("of"), F.when(whole, 1).otherwise(blocks).alias("own_blocks"), F.when(whole, one).otherwise(near).alias("near"), whole.alias("whole"))
    light = cut(light.join(held, ["component", "class"]).join(copies.withColumnRenamed("owner", "doc_id"), "doc_id"))
    n_groups = max(1, math.ceil(light.count() / (2 * block)))
    sets = sets.join(light, ["doc_id", "class"])
    me = F.struct(F.col("of").alias("class"), F.pmod(F.xxhash64("doc_id"), "own_blocks").cast("int").alias("block"))
    spread = F.flatten(F.transform("near", lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: F.struct(c["class"].alias("class"), b.alias("block")))))
    sets = sets.withColumn("me", me).withColumn("other", F.explode(spread))
    sets = sets.select("component", "doc_id", "copies", "blob", "whole", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), (F.col("me") > F.col("other")).cast("int").alias("side"))
    # groups of one block share a task's group; a pair of blocks of a larger one has its own
    cell = F.when(F.col("whole"), F.pmod(F.xxhash64("component"), F.lit(n_groups))).otherwise(F.xxhash64("component", "i", "j"))
    sets = sets.withColumn("cell", cell).select("component", "doc_id", "copies", "blob", F.xxhash64("i").alias("i"), F.xxhash64("j").alias("j"), "side", "cell")
    linked = cut(sets.groupBy("cell").applyInArrow(grouped(_join_cells(percent)), "kind int, a long, b long"))
    joined = components(linked.filter("kind = 0").select("a", "b"))
    partners = cut(linked.filter("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("partners")))
    told = cut(joined.join(partners, "node", "left")).join(copies.withColumnRenamed("owner", "node"), "node", "full_outer")
    told = cut(told.select(F.col("node").alias("owner"), "component", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("links")))
    joined = members.join(told, "owner", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "owner").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each component: that with the smallest doc_id (of rows that share it, the first by text), and rows
    without id; in docs' own columns."""
    linked = link_documents(docs, **how)
    ids = cut(linked.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("component_id").alias("c"), F.count("*").alias("n")).filter("n > 1 OR c <> doc_id"))
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = rows.join(ids.filter("c <> doc_id").select("doc_id"), "doc_id", "left_anti")
    repeated = ids.filter("n > 1 AND c = doc_id").select("doc_id")
    if repeated.isEmpty():
        return unpacked(kept.select("row"), docs)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    once = kept.join(repeated, "doc_id", "left_semi").select("row", first.alias("nth")).filter("nth = 1").select("row")
    return unpacked(kept.join(repeated, "doc_id", "left_anti").select("row").union(once), docs)

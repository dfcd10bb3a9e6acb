"""Exact top-k by inner product: columnar branch and bound.

Components become floor(256 x). `PIVOTS` vectors, those with the least hashes of their ids, divide all vectors into groups:
each goes with the pivot at the smallest angle. Of a group its widest angle and largest norm are known, so no vector in it
can score more with a query than the norms' product times the cosine of the angle that is left between them; this bound
also tells groups apart where all norms are equal. Groups are cut into blocks of bounded size. A candidate lies in one
block and is never copied; a query goes to a block of its nearest group first, which gives it a k-th best score, and then
to the blocks of all groups that can still reach that score. Candidates of a block come before its queries, sorted inside
the partitions, so a task holds one block and reads queries as a stream, however many there are. Inside, vectors lie
dimension by dimension. Scores accumulate one block of dimensions at a time; before each, a candidate survives only if its
partial score plus the product of the remaining norms of both vectors (Cauchy-Schwarz) can still reach the k-th best score
known, and the survivors are compacted. Ties are kept, so the result is exact.
Vectors that are null, empty of meaning (null or non-finite components) or without id take no part; a query never meets
rows of its own id; rows that repeat an id are candidates each, and searched for together; shorter vectors count as
zero-padded; vectors may be long; scores beyond 64 bits are clipped; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates of a block.
CANDIDATES = 8192
#: Vectors that divide the others into groups; they, and a size, an angle and a norm of each group are all that the driver
#: sees.
PIVOTS = 64
DIMS = 8
#: Angles are taken this much wider than computed.
SLACK = 1e-7
_OUT = "query_id long, vec_id long, score long"
_EXACT = 2.0**52


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as the columns of a matrix, zero-padded."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths()) if len(column) else np.zeros(0, int)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), rows] = flat
    return out


def _tails(m: np.ndarray, step: int) -> list[np.ndarray]:
    """Norm of each vector from dimension d on, for d = 0, step, ..."""
    return [np.sqrt((m[d:] ** 2).sum(0)) for d in range(0, m.shape[0] + step, step)]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, step: int = DIMS, bounds: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in this block, those below its bound left out at will. Columns of x
    and q are vectors."""
    dims = max(x.shape[0], q.shape[0])
    x, q = (np.pad(m, ((0, dims - m.shape[0]), (0, 0))) for m in (x, q))
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dims, 1)
    if top >= _EXACT:
        return _search_wide(ids, x, query_ids, q, k)
    x_tail, q_tail = _tails(x, step), _tails(q, step)
    seeds, out = min(len(ids), 64), []
    first = q[:step].T @ x[:step] if len(ids) * len(query_ids) <= 1 << 24 else None
    for j, query in enumerate(query_ids):
        v = q[:, j]
        known = np.where(ids[:seeds] == query, -np.inf, v @ x[:, :seeds])
        least = np.partition(known, -k)[-k] if seeds > k else -np.inf
        if bounds is not None:
            least = max(least, bounds[j])
        alive = np.flatnonzero((ids != query) & (q_tail[0][j] * x_tail[0] >= least - 1e-6 * (1 + abs(least))))
        score = first[j, alive] if first is not None else v[:step] @ x[:step, alive]
        for b, d in enumerate(range(step, dims, step), 1):
            keep = score + q_tail[b][j] * x_tail[b][alive] >= least - 1e-6 * (1 + abs(least))
            alive, score = alive[keep], score[keep]
            score = score + v[d : d + step] @ x[d : d + step, alive]
            if len(score) > k:  # partial score less the remaining mass is a score surely reached
                least = max(least, np.partition(score - q_tail[b + 1][j] * x_tail[b + 1][alive], -k)[-k])
        best = np.lexsort((ids[alive], -score))[:k]
        out += [(int(query), int(ids[alive[i]]), int(score[i])) for i in best]
    return out


def _search_wide(ids, x, query_ids, q, k):
    """The same for components too large for exact doubles: Python integers."""
    vectors = [[int(c) for c in x[:, i]] for i in range(x.shape[1])]
    out = []
    for j, query in enumerate(query_ids):
        v = [int(c) for c in q[:, j]]
        scored = sorted((-sum(map(int.__mul__, v, w)), int(i)) for i, w in zip(ids, vectors, strict=True) if i != query)
        out += [(int(query), i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scored[:k]]
    return out


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of length 1 (zero columns stay) and their norms."""
    most = np.abs(m).max(0, initial=0)
    safe = np.where(most > 0, most, 1.0)
    norm = np.sqrt(((m / safe) ** 2).sum(0))
    return m / safe / np.where(norm > 0, norm, 1.0), norm * safe


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between pivots (rows) and unit vectors (columns), which may differ in length."""
    dims = max(len(unit), pivots.shape[1])
    unit, pivots = np.pad(unit, ((0, dims - len(unit)), (0, 0))), np.pad(pivots, ((0, 0), (0, dims - pivots.shape[1])))
    return np.arccos(np.clip(pivots @ unit, -1, 1))


def _grouped(pivots: np.ndarray):
    """id, v, group, angle, norm; the zero vectors are a group of their own, after the pivots'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, norm = _unit(_matrix(batch.column(1)))
            angles = _angles(unit, pivots)
            group = np.where(norm > 0, angles.argmin(0), len(pivots))
            angle = np.where(norm > 0, angles.min(0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(group.astype(np.int32)), pa.array(angle), pa.array(norm)], ["id", "v", "group", "angle", "norm"])

    return run


def reach(unit: np.ndarray, norm: np.ndarray, pivots: np.ndarray, widest: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The most that a vector of each group (rows) can score with each query (columns)."""
    apart = np.vstack([_angles(unit, pivots), np.zeros((1, unit.shape[1]))])
    left = np.clip(apart - widest[:, None] - SLACK, 0, None)
    # a group beyond a right angle scores below zero, but how far depends on its smallest norm
    return np.clip(np.cos(np.minimum(left, math.pi)), 0, None) * most[:, None] * norm * (1 + 1e-9)


def _bounded(pivots: np.ndarray, widest: np.ndarray, most: np.ndarray, home: bool):
    """id, v, group, bound: queries with the group that they can score most in, or all groups that reach their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, norm = _unit(_matrix(batch.column(1)))
            ceiling = reach(unit, norm, pivots, widest, most)
            ceiling[most < 0] = -np.inf  # groups without a vector
            bound = np.asarray(batch.column(2).fill_null(-math.inf), dtype=np.float64)
            if home:
                query, group = np.arange(batch.num_rows), ceiling.argmax(0)
            else:
                query, group = np.nonzero(((ceiling + 1e-6 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0.0))) >= bound) & np.isfinite(ceiling)).T)
            rows = batch.take(pa.array(query))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(group.astype(np.int32)), rows.column(2)], ["id", "v", "group", "bound"])

    return run


def _searched(k: int):
    """Searches blocks; rows come as block, is_query, id, v, bound, in order of the first two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, matrix = None, [], [], None
        for batch in batches:
            of, query = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8()))
            starts = np.flatnonzero(np.diff(of.astype(np.int64) * 2 + query, prepend=-1))
            for s, e in zip(starts, [*starts[1:], len(of)], strict=True):
                rows = batch.slice(s, e - s)
                if of[s] != block:
                    block, ids, parts, matrix = of[s], [], [], None
                if not query[s]:
                    ids.append(np.asarray(rows.column(2)))
                    parts.append(_matrix(rows.column(3)))
                    continue
                if matrix is None and ids:
                    dims = max(len(p) for p in parts)
                    matrix, own = np.hstack([np.pad(p, ((0, dims - len(p)), (0, 0))) for p in parts]), np.concatenate(ids)
                    parts = []
                if not ids:
                    continue
                bounds = np.asarray(rows.column(4).fill_null(-math.inf), dtype=np.float64)
                found = search_block(own, matrix, np.asarray(rows.column(2)), _matrix(rows.column(3)), k, bounds=bounds)
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose id is divisible by `every`."""
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
    # floor() of a double that no long can hold would overflow; such components stay doubles, which are whole anyway
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * F.lit(scale)).cast("double")).otherwise(c * F.lit(scale))
    v = v.select("id", F.transform("v", whole).alias("v"))
    sample = v.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS).select("v").toArrow()["v"].combine_chunks()
    pivots = _unit(_matrix(sample))[0].T if len(sample) else np.zeros((1, 1))
    dealt = cut(v.mapInArrow(_grouped(pivots), "id long, v array<double>, group int, angle double, norm double"))
    held = {r["group"]: r for r in dealt.groupBy("group").agg(F.count("*").alias("n"), F.max("angle").alias("widest"), F.max("norm").alias("most")).collect()}
    groups = range(len(pivots) + 1)
    widest = np.array([held[g]["widest"] if g in held else 0.0 for g in groups])
    most = np.array([held[g]["most"] if g in held else -1.0 for g in groups])
    parts = [max(1, math.ceil(held[g]["n"] / CANDIDATES)) if g in held else 0 for g in groups]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()  # of each group's blocks
    blocks = max(first[-1], 1)
    at = lambda values, c: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col(c) + 1)
    own = at(first, "group") + F.pmod(F.xxhash64("id", "v"), at([max(p, 1) for p in parts], "group")).cast("int")
    candidates = dealt.select(own.alias("block"), F.lit(False).alias("is_query"), "id", "v", F.lit(None).cast("double").alias("bound"), "group")
    queries = dealt.filter(F.pmod("id", F.lit(every)) == 0).select("id", "v").distinct()

    def searched(mine: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        rows = mine.select("block", "is_query", "id", "v", "bound").union(asked.select("block", F.lit(True), "id", "v", "bound"))
        return rows.repartition(n, "block").sortWithinPartitions("block", "is_query").mapInArrow(_searched(k), _OUT)

    asking = "id long, v array<double>, group int, bound double"
    started = queries.withColumn("bound", F.lit(None).cast("double")).mapInArrow(_bounded(pivots, widest, most, True), asking)
    opening = F.col("block") == at(first, "group")
    near = cut(searched(candidates.filter(opening), started.withColumn("block", at(first, "group")), min(blocks, len(pivots) + 1)))
    bound = near.groupBy(F.col("query_id").alias("id")).agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).cast("double").alias("bound"))
    # a query may have started with other vectors under its id, or in an opening block that others skip
    homes = started.select("id", "v", F.col("group").alias("home")).distinct()
    going = queries.join(bound, "id", "left").select("id", "v", "bound").mapInArrow(_bounded(pivots, widest, most, False), asking)
    going = going.withColumn("block", F.explode(F.sequence(at(first, "group"), at(first, "group") + at([max(p, 1) for p in parts], "group") - 1)))
    going = going.join(homes, ["id", "v"]).filter(~((F.col("home") == F.col("group")) & opening))
    far = searched(candidates, going, blocks)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.union(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

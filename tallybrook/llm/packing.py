"""Packing into optimal length buckets.

The histogram of lengths goes to the driver: one row for each distinct length, of which there are at most as many as
the root of twice all words, since k lengths take k (k - 1) / 2 words at least. A dynamic program chooses the `buckets`
upper bounds that minimise total padding. Inside each bucket documents are padded to its bound and batches hold at most
`budget` padded tokens (a longer document is a batch of its own). Buckets are split by a hash of the id into slices of a
few batches each, so no task gets a whole bucket; rows without id are dealt by their place.
A document's length is its words plus one end mark, however long it is; null or empty texts have length 1. Documents of
one length may change places. Repeated rows are packed as often as they stand; other columns are not read; an empty
table gives an empty result. Rows of equal id and length share a slice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .mix import with_words

BUCKETS = 8
BUDGET = 65_536


def optimal_bounds(lengths, counts, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, that minimise sum(count * (bound - length)); at most `buckets` of them.

    With documents numbered by length, a bucket of lengths i + 1 to j costs size[j] * (total[j] - total[i]) - (mass[j] -
    mass[i]). For each j that is a line in size[j] for each i, so one more bucket takes one walk along the lines' lower
    hull: in all, buckets times distinct lengths steps, in whole numbers."""
    held = sorted((int(s), int(n)) for s, n in zip(lengths, counts, strict=True))
    size, m = [s for s, _ in held], len(held)
    total, mass = [0], [0]
    for s, n in held:
        total.append(total[-1] + n)
        mass.append(mass[-1] + n * s)
    best = [0, *(size[j - 1] * total[j] - mass[j] for j in range(1, m + 1))]
    cuts: list[list[int]] = []
    for _ in range(1, min(buckets, m)):
        new, before, hull, at = [0] * (m + 1), [0] * (m + 1), [], 0  # hull: (total, height, i), slopes falling
        for j in range(1, m + 1):
            line = (total[j - 1], best[j - 1] + mass[j - 1], j - 1)
            while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (line[0] - hull[-2][0]):
                hull.pop()
            hull.append(line)
            at, x = min(at, len(hull) - 1), size[j - 1]
            while at + 1 < len(hull) and hull[at + 1][1] - x * hull[at + 1][0] <= hull[at][1] - x * hull[at][0]:
                at += 1
            new[j], before[j] = hull[at][1] - x * hull[at][0] + x * total[j] - mass[j], hull[at][2]
        best = new
        cuts.append(before)
    bounds, j = [], m
    for before in [*reversed(cuts), None]:
        if j <= 0:
            break
        bounds.append(size[j - 1])
        j = before[j] if before is not None else 0
    return bounds[::-1]


def padding(lengths, counts, bounds) -> int:
    at = np.searchsorted(bounds, lengths)
    return int((np.asarray(counts) * (np.asarray(bounds)[at] - np.asarray(lengths))).sum())


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, length, bucket, bound, padding, batch and position for every document."""
    sized = with_words(docs.select("doc_id", "text"), "length")
    sized = sized.select("doc_id", (F.col("length") + 1).alias("length"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("nth"))
    sized = cut(sized)  # two uses: histogram and assignment
    histogram = sized.groupBy("length").count().toArrow()
    lengths, counts = (np.asarray(histogram[c]) for c in ("length", "count"))
    bounds = optimal_bounds(lengths, counts, buckets) or [1]
    held = np.bincount(np.searchsorted(bounds, lengths), counts, len(bounds))
    room = [max(1, budget // b) for b in bounds]
    slices = [max(1, round(held[i] / max(1024, 8 * room[i]))) for i in range(len(bounds))]
    pick = lambda values, at: F.element_at(F.array(*(F.lit(int(x)) for x in values)), at + 1)
    bucket = sum(((F.col("length") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    dealt = sized.withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64("doc_id", "length", "nth"), pick(slices, F.col("bucket"))).cast("int"))
    within = Window.partitionBy("bucket", "slice").orderBy("doc_id", "length", "nth")
    dealt = dealt.withColumn("at", F.row_number().over(within) - 1).withColumn("room", pick(room, F.col("bucket")))
    bound = pick(bounds, F.col("bucket")).cast("long")
    batch = F.format_string("%d-%d-%d", "bucket", "slice", F.floor(F.col("at") / F.col("room")))
    return dealt.select("doc_id", "length", "bucket", bound.alias("bound"), (bound - F.col("length")).alias("padding"), batch.alias("batch"), (F.col("at") % F.col("room")).alias("position"))

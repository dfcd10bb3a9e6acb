"""Mixing sources to target weights.

One pass over the texts writes each document's size. Words per source are summed (partially on the map side, so a hot
source costs one row a task). Shares of the wanted total follow the weights, but no source may exceed `cap` times its
size; the excess is dealt again by weight until no source is above its cap: each round sums what full sources take and
what the others weigh, until no more sources are full. Sources get their weights by their place in order; they are
numbered by a range-partitioned sort, so there may be as many sources as a sum by source has rows.
A document is emitted floor(rate) times, plus once more if a hash of the seed and its id falls below the fraction. Each
source draws under that one of `DRAWS` seeds which brings its taken words nearest to its target; one pass over the sizes
sums the words that each seed would take.
Null texts have size 0, a null source is a source of its own (last in order), sources of size 0 get target 0, rows
without id draw as one id, repeated rows draw alike, long texts count like short ones, an empty table gives an empty
result, columns of any names are kept as they are, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, unpacked, whole_row

WEIGHTS = (3, 1, 2)
SEED = 20240117
DRAWS = 16
#: Sources up to which the target table (one row a source) is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000
#: Bytes up to which the longest name of a source may go for that.
BROADCAST_NAME = 1_000


def count_words(text: bytes, piece: int = 1 << 20) -> int:
    """Words of a text, however long, counted piece by piece."""
    if len(text) <= piece:
        return len(text.split())
    parts = [text[i : i + piece] for i in range(0, len(text), piece)]
    # a word that goes on in the next piece was counted twice
    return sum(len(p.split()) for p in parts) - sum(not a[-1:].isspace() and not b[:1].isspace() for a, b in zip(parts, parts[1:], strict=False))


def with_words(df: DataFrame, name: str = "size", text_col: str = "text") -> DataFrame:
    """df with the number of words of its text column."""
    schema = df.drop(name).schema.add(name, "long")
    at = df.drop(name).columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            n = pa.array([count_words(t.as_py()) if t.is_valid else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, name])

    return df.drop(name).mapInArrow(run, schema)


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document, written once."""
    sized = with_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))
    return cut(sized.select("doc_id", "source", "size"))


def _numbered(per: DataFrame) -> DataFrame:
    """per with `place`: the number, from 0, of each source in order, null last."""
    order = F.col("source").asc_nulls_last()
    dealt = cut(per.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    first, firsts = 0, {}
    for r in sorted(dealt.groupBy("part").count().collect()):  # one row a partition
        firsts[r["part"]], first = first, first + r["count"]
    start = F.element_at(F.create_map(*(F.lit(int(x)) for kv in firsts.items() for x in kv)), F.col("part")) if firsts else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("place", start + within).drop("part")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: one row a source. sizes: source, size."""
    per = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    per = cut(per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")))
    wanted = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, filled, full = 0.0, -1, F.lit(False)
    while True:
        n, taken, open_ = per.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == filled or not open_:
            break
        filled, level = n, (wanted - (taken or 0.0)) / open_
        full = F.col("most") / F.col("weight") <= F.lit(level)
    return per.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def uniform(id_col, draw, seed: int = SEED):
    """A number in [0, 1) from seed + draw and the id: the first 52 bits of an MD5 digest."""
    text = F.concat((F.lit(seed) + draw).cast("string"), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _joined(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (with a column source) with their source's target; the targets are broadcast if they are few and small."""
    targets = targets.withColumnRenamed("source", "of_source")
    n, size = targets.agg(F.count("*"), F.max(F.octet_length("of_source"))).first()
    if n <= BROADCAST_SOURCES and (size or 0) <= BROADCAST_NAME:
        targets = F.broadcast(targets)
    return rows.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def with_draws(sizes: DataFrame, targets: DataFrame, seed: int = SEED, draws: int = DRAWS) -> DataFrame:
    """targets with rate and the draw that comes nearest. sizes: doc_id, source, size."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate)
    fraction = F.col("rate") - F.floor("rate")
    taken = [F.sum(F.when(uniform(F.col("doc_id"), F.lit(k), seed) < fraction, F.col("size")).otherwise(0)).alias(f"t{k}") for k in range(draws)]
    sums = _joined(sizes, targets.select("source", "rate")).groupBy(F.col("source").alias("of_source")).agg(*taken)
    off = lambda k: F.abs(F.col("target") - F.floor("rate") * F.col("source_size") - F.col(f"t{k}"))
    best = F.array_min(F.array(*(F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(draws))))["k"]
    return targets.join(sums, F.col("source").eqNullSafe(F.col("of_source"))).select("source", "source_size", "target", "rate", best.alias("draw"))


def _targets(sizes: DataFrame, seed: int, **how) -> DataFrame:
    return cut(with_draws(sizes, cut(source_targets(sizes, **how)), seed))


def _copies(rate, draw, seed: int):
    return F.floor(rate) + (uniform(F.col("doc_id"), draw, seed) < rate - F.floor(rate)).cast("long")


def mix_plan(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every document."""
    sizes = _sizes(docs)
    joined = _joined(sizes, _targets(sizes, seed, **how))
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("rate"), F.col("draw"), seed).alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mixed documents themselves, with the columns of docs; each as often as the mix takes it."""
    targets = _targets(_sizes(docs), seed, **how).select("source", "rate", "draw")
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), "source")
    taken = _joined(rows, targets).withColumn("n", _copies(F.col("rate"), F.col("draw"), seed)).filter("n > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))), docs)


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM s),
     l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
     f AS (SELECT *, most / weight <= level AS filled FROM l),
     t AS (SELECT source, source_size, CASE WHEN filled THEN most ELSE weight * (SELECT level FROM f WHERE NOT filled ORDER BY most / weight, source NULLS LAST LIMIT 1) END AS target FROM f),
     g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
     u AS (SELECT d.source, k, sum(CASE WHEN CAST(('0x' || substr(md5(({SEED} + k) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN size ELSE 0 END) AS taken
           FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, range({DRAWS}) AS r(k) GROUP BY d.source, k),
     b AS (SELECT g.source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(rate) AS rate,
             arg_min(k, (abs(target - CAST(floor(rate) AS BIGINT) * source_size - CAST(taken AS BIGINT)), k)) AS draw
           FROM g JOIN u ON g.source IS NOT DISTINCT FROM u.source GROUP BY g.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
  CAST(('0x' || substr(md5(({SEED} + draw) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source"""

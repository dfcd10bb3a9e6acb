"""Whitening of embeddings: principal components of the distinct vectors, and every row projected on them.

Each component c becomes the whole number x = floor(64 c) + 1,000,000. The *fit list* is every distinct x vector once (n of
them, per-dimension sums S). Its rows are centred exactly, n x - S in whole numbers, before anything is multiplied; MLlib's
RowMatrix sums their outer products over the cluster, and the Gramian divided by n is the covariance. Its eigenvectors are
found on the driver, which sees dimensions squared numbers and no row, and go to the executors as a broadcast of at most
(16 + 1) x dimensions numbers, whatever the table's size.

Rows whose vector is null, or holds null or non-finite entries, take no part. Shorter vectors count as zero-padded. An
entry whose x no long can hold is clipped. Repeated vectors are fitted once and projected each; null ids are projected
like others; other columns are not read; an empty table, or one of empty vectors only, gives an empty result. Vectors may
be as long as the driver can hold their covariance. Components without variance have `explained` 0 and a null `whitened`,
and are no part of `identity_error`; `deviation` is null where no long can hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

COMPONENTS = 16
SCALE = 64.0
#: x is this much more than floor(64 c). Centring takes it away again, so the code below carries x - OFFSET.
OFFSET = 1_000_000
#: Eigenvalues below this share of the largest are rounding, not variance.
NO_VARIANCE = 1e-12
_LONG = 2**63
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and y = x - OFFSET of the rows that take part, all of one length; and that length."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.filter(F.col("v").isNotNull() & finite)
    dims = v.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))
    # floor() of a double that no long can hold gives the nearest long; OFFSET is kept clear of both ends
    edge = F.lit(_LONG - 2 * OFFSET)
    y = F.transform(padded, lambda c: F.greatest(F.least(F.floor(c * F.lit(SCALE)), edge), -edge))
    return v.select("vec_id", y.alias("y")), dims


def _gramian(rows: DataFrame, dims: int) -> np.ndarray:
    """Sum of the outer products of rows' only column, arrays of doubles."""
    as_vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(rows.columns[0]).alias("v")), "v")
    return RowMatrix(as_vectors, 0, dims).computeGramianMatrix().toArray()


def _centred(n: int, sums: list[int], most: int) -> Column:
    """(n y - S) / n of each entry, whole until the division."""
    kind = "long" if 2 * n * most < _LONG else "decimal(38,0)"
    centre = F.array(*(F.lit(str(s)).cast(kind) for s in sums))
    return F.zip_with("y", centre, lambda c, s: (c.cast(kind) * F.lit(n).cast(kind) - s).cast("double") / F.lit(float(n)))


def deviations(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """(n y - S) / n as doubles, and the exact sum over dimensions of (n y - S) squared; None where no long can hold it."""
    most = max(int(np.abs(y).max(initial=0)), 1)
    if 2 * n * most < _LONG:
        d = y * n - np.array(sums, dtype=np.int64)
        if d.shape[1] * (2 * n * most) ** 2 < _LONG:
            return d / n, (d * d).sum(1).tolist()
    else:
        d = y.astype(object) * n - np.array(sums, dtype=object)
    exact = (sum(int(c) ** 2 for c in row) for row in d)
    return (d / n).astype(np.float64), [e if e < _LONG else None for e in exact]


def _projected(rows: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    """rows' first column, deviation and z: the projections of each row on the axes."""
    first, held = rows.columns[0], rows.sparkSession.sparkContext.broadcast((n, sums, axes))
    # as text, since pandas would make doubles of whole numbers with nulls among them
    kind, rows = rows.schema[first].dataType.simpleString(), rows.withColumn(first, F.col(first).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, axes = held.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                centred, deviation = deviations(np.stack(part["y"].to_numpy()).astype(np.int64), n, sums)
                yield pd.DataFrame({first: part[first].to_numpy(), "deviation": pd.array(deviation, "Int64"), "z": list(centred @ axes)})

    return rows.mapInPandas(run, f"{first} string, deviation long, z array<double>").withColumn(first, F.col(first).cast(kind))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row that takes part."""
    spark = vectors.sparkSession
    rows, dims = whole_vectors(vectors, id_col, vector_col)
    if not dims:
        return spark.createDataFrame([], _OUT)
    fit = cut(rows.select("y").distinct())
    n, most = fit.agg(F.count("*"), F.max(F.array_max(F.transform("y", lambda c: F.abs(c))))).first()
    entries = fit.select(F.posexplode("y").alias("at", "c"))
    totals = {r["at"]: int(r["total"]) for r in entries.groupBy("at").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("total")).collect()}
    sums = [totals[i] for i in range(dims)]
    covariance = _gramian(fit.select(_centred(n, sums, most).alias("centred")), dims) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = np.maximum(values[::-1], 0.0)[:components], axes[:, ::-1][:, :components]
    varied = int((values > NO_VARIANCE * values[0]).sum()) if values[0] > 0 else 0
    axes = axes[:, :varied] / np.sqrt(values[:varied])
    trace = float(np.trace(covariance))
    explained = [float(v) / trace if i < varied else 0.0 for i, v in enumerate(values)]
    error = _identity_error(_projected(fit.select(F.lit(0).alias("none"), "y"), n, sums, axes).select("z"), n, varied)
    discard(fit)
    out = _projected(rows, n, sums, axes)
    out = out.select("vec_id", "deviation", "z", F.posexplode(F.array(*map(F.lit, explained))).alias("at", "explained"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("z", F.col("at")).alias("whitened"), "explained", F.lit(error).alias("identity_error"),
    )


def _identity_error(z: DataFrame, n: int, varied: int) -> float:
    """Largest absolute entry of the covariance of z, centred first, minus the identity."""
    if not varied:
        return 0.0
    means = {r["at"]: r["mean"] for r in z.select(F.posexplode("z").alias("at", "c")).groupBy("at").agg(F.avg("c").alias("mean")).collect()}
    centre = F.array(*(F.lit(means[i]) for i in range(varied)))
    covariance = _gramian(z.select(F.zip_with("z", centre, lambda c, m: c - m).alias("z")), varied) / n
    return float(np.abs(covariance - np.eye(varied)).max())

"""What the text operators share: reading tables, hot-key salts, shared-folder writes and chunked exchanges."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct `row` of numbered fields, so that no helper column can clash with them."""
    return F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from such a struct."""
    return rows.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared folder; sets one only where none is configured (local tests)."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            import tempfile

            path = tempfile.mkdtemp(prefix="tallybrook-")
        spark.sparkContext.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing will read it again."""
    for df in tables:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def input_partitions(df: DataFrame) -> int:
    """Splits that Spark plans for df's scan: its measure of the input's size."""
    return max(1, df.rdd.getNumPartitions())


def chunk_count(df: DataFrame, splits_per_chunk: float = 1.0) -> int:
    """Chunks that grow with the input, so that the bytes of one chunk don't."""
    return max(2, math.ceil(input_partitions(df) / splits_per_chunk))

"""The shared folder: where lineage is cut and streams keep their state."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; not so with local-cluster, which starts workers."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Local runs without one get a temporary folder."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not on_one_machine(spark):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            path = tempfile.mkdtemp(prefix="tallybrook-")
        spark.sparkContext.setCheckpointDir(path)
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there."""
    shared_folder(df.sparkSession)
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

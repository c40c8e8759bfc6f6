"""Session helpers: table readers, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory. Python workers get this package's place, wherever the driver was started."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset and the master is this machine (tests) a folder of it is set; on a cluster
    an unset folder is an error, since executors would write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[\w*,]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.gettempdir() + "/lodestrata-shared"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and the files outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize` when nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = file.rpartition("/")[0]
        if path.split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/")):
            remove(spark, path)


class Scratch:
    """A folder of intermediate tables within the shared folder; :meth:`close` deletes it with everything in it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
        """As :func:`materialize`, in this folder; ``by`` are the columns that name the files' folders."""
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove(self.spark, self.path)


def input_parts(df: DataFrame) -> int:
    """Number of input splits: a measure of size that costs no job."""
    return max(1, df.rdd.getNumPartitions())

"""Files that arrive in a folder, taken in as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import DEFAULTS, Settings
from lodestrata.operators.provider import Provider
from lodestrata.plans.pipeline import ingest_files
from lodestrata.sources.uploads import uploads_of


def uploads(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over parquet files of uploads that are dropped into a folder."""
    return spark.readStream.schema(schema).parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """A stream over PDF files that are dropped into a folder, as uploads."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return uploads_of(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").load(path))


def take_in(spark: SparkSession, path: str, root: str, provider: Provider, parse, checkpoint: str, settings: Settings = DEFAULTS):
    """Takes the files that are in the folder and weren't taken yet into the snapshot at ``root``, then stops. A batch that is repeated after a
    failure adds nothing twice, since known contents are skipped."""
    return run(files(spark, path), lambda batch, _: ingest_files(spark, batch, root, provider, parse, settings).count(), checkpoint)


def distinct_uploads(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Uploads whose content hash wasn't seen within ``delay`` of event time (ingested_at); the state is dropped with the watermark."""
    timed = stream.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withColumn("sha256", F.lower("sha256"))
    return timed.where("sha256 is not null").withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Gives each micro-batch to ``each``, all that is there, then stops; progress is kept in ``checkpoint``."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """Uploads of each day by state, late ones counted until the watermark passes."""
    timed = stream.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", delay)
    return timed.groupBy(F.window("ingested_at", "1 day").alias("day"), "status").agg(F.count("*").alias("n"))

"""The inverted index: terms, postings and statistics, as tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import DEFAULTS
from lodestrata.functions.text import indexed_text, tokens


def token_rows(chunks: DataFrame, row: str = "embedding_row", text: str = "text", title: str | None = "section_title") -> DataFrame:
    """row, terms, dl of each indexed chunk: its terms in order and how many. Chunks without row aren't indexed; empty ones count with dl 0."""
    body = indexed_text(F.col(title), F.col(text)) if title else F.col(text)
    rows = chunks.where(F.col(row).isNotNull()).select(F.col(row).alias("row"), tokens(body).alias("terms"))
    return rows.select("row", "terms", F.size("terms").cast("bigint").alias("dl"))


def postings(rows: DataFrame) -> DataFrame:
    """term, row, tf, dl."""
    return rows.select("row", "dl", F.explode("terms").alias("term")).groupBy("term", "row", "dl").agg(F.count("*").alias("tf")).select("term", "row", "tf", "dl")


def term_df(posts: DataFrame) -> DataFrame:
    """term, df: in how many rows a term occurs."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row: n (all rows, empty ones too), avgdl (0 without rows)."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n, df):
    """Never below 0.01."""
    return F.greatest(F.lit(0.01), F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)))


#: Folders of an index.
BUCKETS = 64


def bucket_of(term: Column, buckets: int) -> Column:
    """The folder of a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """A saved index: postings (term, row, tf, dl, bucket), in a folder for each of ``buckets``, and stats (one row)."""

    postings: DataFrame
    stats: DataFrame
    buckets: int
    version: str


def save(rows: DataFrame, path: str, buckets: int = BUCKETS, version: str = DEFAULTS.tokenizer_version) -> Index:
    """Writes the index of ``rows`` (row, terms, dl) and opens it. A hot term is split over several files of its folder."""
    posts = postings(rows).withColumn("bucket", bucket_of(F.col("term"), buckets))
    posts.repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    corpus_stats(rows).withColumn("buckets", F.lit(buckets)).withColumn("tokenizer_version", F.lit(version)).write.parquet(f"{path}/stats")
    return load(rows.sparkSession, path)


def load(spark: SparkSession, path: str) -> Index:
    """The index saved at ``path``."""
    stats = spark.read.parquet(f"{path}/stats")
    first = stats.first()
    posts = spark.read.schema("term string, row bigint, tf bigint, dl bigint, bucket int").parquet(f"{path}/postings")
    return Index(posts, stats.select("n", "avgdl"), first.buckets, tokenizer_version(stats))


def current(rows: DataFrame, path: str, version: str = DEFAULTS.tokenizer_version) -> Index:
    """The saved index if it was made with this tokenizer and covers as many rows, else one made anew beside it."""
    spark = rows.sparkSession
    try:
        index = load(spark, path)
    except AnalysisException:
        return save(rows, path, version=version)
    if index.version == version and index.stats.first().n == rows.count():
        return index
    return save(rows, f"{path}-{uuid.uuid4().hex}", index.buckets, version)


def tokenizer_version(stats: DataFrame) -> str:
    """The version an index was made with; one without any is v1, an empty index too."""
    if "tokenizer_version" not in stats.columns:
        return "v1"
    first = stats.select("tokenizer_version").first()
    return (first[0] if first else None) or "v1"

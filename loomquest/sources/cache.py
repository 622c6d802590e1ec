"""The cache of answers: Parquet keyed by SHA-1 of backend, query and limit, laid out by bucket, the key's first two characters. Empty answers are never stored.

A lookup names its keys, and reads the buckets of those alone. Storing adds files; compacted() brings a bucket that has many back to one file, without what has grown old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquest.sources.tables import saved, there

TTL_SECONDS = 7 * 24 * 3600
SCHEMA = "key string, fetched_at timestamp, body string, bucket string"
#: Characters of a key that name its bucket: 256 buckets. Files of a bucket from which it is worth writing anew.
BUCKET_CHARS, MOST_FILES = 2, 8


def key(backend, query, n):
    """The limit is part of the key, so a short answer never serves for a long one."""
    return F.substring(F.sha1(F.concat_ws(":", backend, n.cast("string"), query)), 1, 20)


def _bucket(k: Column) -> Column:
    return F.substring(k, 1, BUCKET_CHARS)


def _fresh(ttl: int) -> Column:
    return F.unix_timestamp("fetched_at") > F.unix_timestamp() - ttl


def read(spark: SparkSession, path: str, ttl: int = TTL_SECONDS, keys: DataFrame | None = None) -> DataFrame:
    """key, body: the latest answer of each key that is younger than ttl seconds. keys, a table with column key, limits it to those: only their buckets are read, and what is
    there of them is taken as it is now. No table: no rows."""
    if not there(spark, path):
        return spark.createDataFrame([], "key string, body string")
    rows = spark.read.schema(SCHEMA).parquet(path).where(_fresh(ttl))
    if keys is not None:
        wanted = keys.select("key").distinct()
        buckets = [r.bucket for r in wanted.select(_bucket(F.col("key")).alias("bucket")).distinct().collect()]  # 256 at most
        rows = rows.where(F.col("bucket").isin(buckets)).join(wanted, "key", "left_semi")
    return rows.groupBy("key").agg(F.max_by("body", "fetched_at").alias("body"))


def store(answers: DataFrame, path: str) -> None:
    """answers: key, body. One file for each bucket that gets answers."""
    kept = answers.where("body is not null and body <> ''").select("key", F.current_timestamp().alias("fetched_at"), "body", _bucket(F.col("key")).alias("bucket"))
    kept.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def compacted(spark: SparkSession, path: str, ttl: int = TTL_SECONDS, most: int = MOST_FILES) -> int:
    """Writes the buckets of more than most files anew, one file each, with the latest answer of each key that is younger than ttl; others stay as they are. Returns how many
    were written. To be called while nothing else stores, as at the start of a campaign under its lock."""
    if not there(spark, path):
        return 0
    rows = spark.read.schema(SCHEMA).parquet(path)
    many = [r.bucket for r in rows.groupBy("bucket").agg(F.countDistinct("_metadata.file_path").alias("n")).where(F.col("n") > most).collect()]  # 256 at most
    if not many:
        return 0
    latest = rows.where(F.col("bucket").isin(many) & _fresh(ttl)).groupBy("bucket", "key").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("body", "fetched_at").alias("body"))
    kept = saved(latest.select("key", "fetched_at", "body", "bucket"), "compacted")
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(many)


def misses(requests: DataFrame, cached: DataFrame) -> DataFrame:
    return requests.join(cached.select("key"), "key", "left_anti")

"""A census that grows with its input: each batch of mentions is merged into the state of those before.

Under one folder: urls/batch=N (addresses of a batch), mentions/batch=N/bucket=B (distinct mentions, by the address), and census/slot=S, the merged state after the last batch and the one
before it, in turns, each row with its batch. All of it is Parquet that Spark writes with dynamic partition overwrite, and batch N reads what batches before N left; so a batch
that is run again, after a crash at any place, writes the same rows into the same places.

A batch costs its own rows and the state's keys. Earlier mentions are read only in the buckets of addresses that came before, since sources are counted once by key and address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquest.operators import items
from loomquest.sources.tables import there

BUCKETS = 64
_PAIRS = "key string, url string"


class CensusTable:
    """The tables of a census in a folder, which may be remote. mentions given to add(): item, url, vetted, ord (any type that can be ordered)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table so far; before its first batch it has no rows."""
        if not there(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str, *parts: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def _state(self, first: str) -> DataFrame:
        return self._read("census", f"key string, item string, sources long, vetted boolean, first {first}, fresh boolean, as_of long, slot int")

    def add(self, mentioned: DataFrame, batch: int) -> dict:
        """Merges the mentions of a batch, numbered 0, 1, ... Returns the counts batch, items (keys so far) and fresh (new keys)."""
        found = items.mentions(mentioned)
        kind = found.schema["ord"].dataType.simpleString()
        bucket = F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")
        # One row for each key and address stands for all of its mentions there.
        found = found.groupBy("key", "url").agg(F.min_by("item", "ord").alias("item"), F.bool_or("vetted").alias("vetted"), F.min("ord").alias("ord"))
        self._write(found.withColumns({"batch": F.lit(batch), "bucket": bucket}), "mentions", "batch", "bucket")
        mine = self._read("mentions", f"key string, url string, item string, vetted boolean, ord {kind}, batch long, bucket int").where(F.col("batch") == batch).drop("batch", "bucket")
        self._write(mine.select("url").distinct().withColumn("batch", F.lit(batch)), "urls", "batch")
        again = self._read("urls", "url string, batch long").where(F.col("batch") < batch).join(mine.select("url").distinct(), "url", "left_semi")
        known = [r.bucket for r in again.select(bucket.alias("bucket")).distinct().collect()]  # at most self.buckets rows
        held = self._read("mentions", f"{_PAIRS}, batch long, bucket int").where((F.col("batch") < batch) & F.col("bucket").isin(known)).select("key", "url") if known else self.spark.createDataFrame([], _PAIRS)
        before = self._state(kind).where((F.col("slot") == (batch + 1) % 2) & (F.col("as_of") == batch - 1))
        now = items.merged(before, items.tally(items.marked(mine, held)))
        self._write(now.withColumns({"as_of": F.lit(batch).cast("long"), "slot": F.lit(batch % 2)}), "census", "slot")
        return {"batch": batch} | self._state(kind).where(F.col("slot") == batch % 2).agg(F.count("*").alias("items"), F.count_if("fresh").alias("fresh")).first().asDict()

    def census(self, first: str = "long") -> DataFrame:
        """key, item, sources, vetted, first after the last batch; first is the type of ord."""
        state = self._state(first)
        last = state.agg(F.max("as_of")).first()[0]  # a column of one value a file
        return state.where(F.col("as_of") == F.lit(last)).drop("fresh", "as_of", "slot")

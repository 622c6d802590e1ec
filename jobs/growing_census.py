"""A census of names over a folder of documents that grows: who or what is mentioned, by how many documents, and whether a trusted source says so.

    python -m jobs.growing_census --documents 'harvest/*.parquet' --out census

A harvest adds files day by day; counting all mentions again each time costs more every day. This job is a stream over the folder that stops when nothing is left (availableNow). Its
checkpoint, out/checkpoint, remembers the files that were taken; each batch of new files is merged into the state of those before it (loomquest.streaming.census). A document that comes
again, in another file, is not counted twice. Output: out/result, Parquet partitioned by band (1, 2 to 9 and 10 or more sources: single, some, many), with key, item,
sources, vetted, first_doc and first_line. It is written anew from the state at the end of a run, so one that stopped in between is mended by the next, and a run without
new files leaves the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import logger, main
from loomquest.sources import corpora
from loomquest.streaming.census import CensusTable

log = logger("growing_census")
PLACE = "struct<doc_id:bigint,pos:int>"
RESULT = "key string, item string, sources long, vetted boolean, first_doc long, first_line int, band string"


def run(spark: SparkSession, documents: str, out: str, config: dict) -> DataFrame:
    """Takes the files that are new and returns the whole census, read back. documents is a folder or a pattern of paths."""
    table, read = CensusTable(spark, f"{out}/state", config["buckets"]), []

    def add(batch: DataFrame, number: int) -> None:
        seen = Observation(f"batch {number}")
        facts = corpora.as_facts(batch.select("doc_id", "text", "source").observe(seen, F.count("*").alias("n")))
        mentioned = facts.select(F.col("fact").alias("item"), F.col("doc_id").cast("string").alias("url"), F.coalesce(F.col("query").isin(config["vetting_sources"]), F.lit(False)).alias("vetted"), F.struct("doc_id", "pos").alias("ord"))
        n = table.add(mentioned, number)
        read.append(seen.get["n"])
        log.info("batch %d: %d documents merged, %d names, %d of them new", number, read[-1], n["items"], n["fresh"])

    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    running = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    log.info("read %d new documents from %s in %d batches", sum(read), documents, len(read))
    band = F.when(F.col("sources") >= 10, "many").when(F.col("sources") >= 2, "some").otherwise("single")
    rows = table.census(PLACE).select("key", "item", "sources", "vetted", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_line"), band.alias("band"))
    wrote = Observation("result")
    rows.observe(wrote, F.count("*").alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("band").parquet(f"{out}/result")
    log.info("wrote %d names to %s", wrote.get["n"], f"{out}/result")
    return spark.read.schema(RESULT).parquet(f"{out}/result")


if __name__ == "__main__":
    main("growing_census", __doc__.splitlines()[0], {"documents": "folder or pattern of Parquet files of doc_id, text, source"}, run)

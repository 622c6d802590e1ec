"""Reading lists for a table of research goals: the best sources of each goal out of a whole corpus.

    python -m jobs.reading_lists --documents documents.parquet --labels labels.parquet --goals benchmark.parquet --out lists

Whoever plans many campaigns over one harvest wants to know, before any page is read, which sources answer which goal. Each goal is held against all documents at once, by the
rules that rank the sources of one campaign. Output: Parquet, partitioned by bucket (item_id modulo the setting buckets), with item_id, goal, rank, url, title, source, score and
overlap. A run replaces the buckets that it writes and takes away those of goals that are gone, so a second run leaves the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import logger, main
from loomquest.functions import patterns as P
from loomquest.operators import many
from loomquest.sources import corpora

log = logger("reading_lists")


def run(spark: SparkSession, documents: str, labels: str, goals: str, out: str, config: dict) -> DataFrame:
    """Writes the lists to out and returns them, read back."""
    read, asked, wrote = Observation("documents"), Observation("goals"), Observation("lists")
    docs = spark.read.parquet(documents).select("doc_id", "text", "source")
    wanted = spark.read.parquet(goals).select(F.col("item_id").alias("goal_id"), F.col("text").alias("goal"))
    docs.select("doc_id").observe(read, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    wanted.select("goal_id").observe(asked, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    log.info("read %d documents from %s and %d goals from %s", read.get["n"], documents, asked.get["n"], goals)
    lists = many.rank_for_goals(corpora.as_hits(docs, spark.read.parquet(labels)), wanted.withColumn("listing", F.coalesce(F.col("goal").rlike(P.ENUMERABLE), F.lit(False))), config["sources_per_goal"])
    rows = lists.join(wanted.dropDuplicates(["goal_id"]), "goal_id").select(
        F.col("goal_id").alias("item_id"), "goal", "rank", "url", "title", "source", "score", "overlap", F.pmod("goal_id", F.lit(config["buckets"])).cast("int").alias("bucket")
    )
    # A list is short and a bucket holds some goals: one file each.
    rows.repartition("bucket").observe(wrote, F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("lists")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(out)
    log.info("wrote %d rows of %d lists to %s", wrote.get["n"], wrote.get["lists"], out)
    return spark.read.parquet(out)


if __name__ == "__main__":
    main("reading_lists", __doc__.splitlines()[0], {"documents": "Parquet of doc_id, text, source", "labels": "Parquet of doc_id, quality", "goals": "Parquet of item_id, text"}, run)

"""The jobs as queries: each runs twice over the whole tables into a new folder and gives what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import growing_census, reading_lists
from jobs.common import settings
from loomquest.catalogue import MENTIONS, SOURCES_OF_GOALS
from loomquest.sources.tables import scratch


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def job1_reading_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents' addresses for each benchmark text."""
    out, config = _folder(spark, "job1"), settings("reading_lists")
    for _ in range(2):
        lists = reading_lists.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{sf_dir}/benchmark.parquet", out, config)
    return lists


def job2_growing_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census of what lines of documents mention. A pattern, since a stream takes no single file's path."""
    out, config = _folder(spark, "job2"), settings("growing_census")
    for _ in range(2):
        census = growing_census.run(spark, f"{sf_dir}/document[s].parquet", out, config)
    return census


QUERIES = {f.__name__: f for f in (job1_reading_lists, job2_growing_census)}
ORACLE_SQL = {
    "job1_reading_lists": f"""{SOURCES_OF_GOALS}
SELECT r.item_id, b.text AS goal, rank, url, title, source, score, overlap, CAST(r.item_id % 8 AS INT) AS bucket FROM r JOIN benchmark b USING (item_id)""",
    "job2_growing_census": f"""
WITH m AS (SELECT * FROM {MENTIONS} WHERE length(key) BETWEEN 2 AND 60)
SELECT key, arg_min(item, (doc_id, pos)) AS item, count(DISTINCT doc_id) AS sources, bool_or(source = 'src1') AS vetted, min(doc_id) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_line,
  CASE WHEN count(DISTINCT doc_id) >= 10 THEN 'many' WHEN count(DISTINCT doc_id) >= 2 THEN 'some' ELSE 'single' END AS band FROM m GROUP BY key""",
}

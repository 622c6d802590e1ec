"""Files in and out: query lists, record logs, prior corpora, and where output goes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquest.functions.text import trim
from loomquest.operators.records import CENSUS_RECORD
from loomquest.sources.tables import there


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """ord, query: lines of a text file, trimmed, without blank lines and lines that start with '#'. ord grows with the lines of a file."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(trim(F.col("value")).alias("query")).where("query <> ''")
    return lines.select(F.monotonically_increasing_id().alias("ord"), "query")


def record_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log, one JSON object a line; lines that do not parse go. No file: no rows."""
    if not there(spark, path):
        return spark.createDataFrame([], CENSUS_RECORD)
    rows = spark.read.schema(CENSUS_RECORD + ", _bad string").options(columnNameOfCorruptRecord="_bad", recursiveFileLookup=True).json(path)
    return rows.where("_bad is null and query is not null").drop("_bad")


def append_records(records: DataFrame, path: str, again: bool = False) -> None:
    """Adds records to a log; each call's rows are durable when it returns. again: path is a folder of this call alone inside the log, and what an earlier try left there goes."""
    records.write.mode("overwrite" if again else "append").json(path)


def output_dir(default: str) -> str:
    """LOOM_OUT_DIR where it is an absolute path without unexpanded variables, ~/loomquest where it is not, default where it is unset."""
    d = os.environ.get("LOOM_OUT_DIR", "").strip()
    if not d:
        return default
    return d if os.path.isabs(d) and "${" not in d and "%" not in d else os.path.join(os.path.expanduser("~"), "loomquest")

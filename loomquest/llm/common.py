"""Shared pieces: word splitting, shared-folder tables, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the fast lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sealed(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the columns in names behind a generator, which filters do not move through: the optimiser would else write their whole
    chain of expressions into each filter, again and again."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode(F.array(F.struct(*names))).alias("__sealed")).select(*others, "__sealed.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    (a local session), a temporary folder that is then set as the checkpoint folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext.getCheckpointDir()
        where = held or tempfile.mkdtemp(prefix="loomquest-")
        if not held:
            spark.sparkContext.setCheckpointDir(where)
            where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomquest-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that saved() wrote, once nothing needs them."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomquest-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Gives memory that a Python worker no longer uses back to the system: it serves the tasks of all stages in turn."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of the links (a, b), both long: one row (node, root) per node that has a
    link, root being the smallest node that it reaches.

    Alternates large-star and small-star steps until each node hangs from its root. Each step only joins and
    takes minima, so no task sees a whole component; each round is written to the shared folder, which cuts the
    lineage. Loops, repeated links and nulls are dropped first."""
    e = edges.where("a is not null and b is not null and a <> b")
    e = saved(e.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(
            F.explode(F.array(F.struct(F.col("m").alias("lo"), "hi"), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e")
        )
        after = saved(small.select("e.lo", "e.hi").where("lo < hi").distinct(), "links")
        discard(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())

"""Records (one per query) and their flat forms: hits and facts. Schemas, resume, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.functions import text as X
from loomquest.sources.tables import saved

HIT = "struct<title:string,url:string,snippet:string,source:string>"
DIGEST = "struct<summary:string,facts:array<string>,relevance:double>"
RECORD = f"ord long, query string, n_results int, digest {DIGEST}, results array<{HIT}>, error string"
CENSUS_RECORD = RECORD + ", round int, pages_read int, new_items int, total_items int"


def hits(records: DataFrame) -> DataFrame:
    """One row per hit: rec_ord, hit_ord, query, relevance (0 without a digest), title, url, snippet, source. The order columns carry the
    order of records and of hits in them, which all first-seen rules go by."""
    r = records.select(F.col("ord").alias("rec_ord"), "query", F.coalesce("digest.relevance", F.lit(0.0)).alias("relevance"), F.posexplode("results").alias("hit_ord", "hit"))
    return r.select("rec_ord", "hit_ord", "query", "relevance", "hit.title", "hit.url", "hit.snippet", "hit.source")


def digest_facts(records: DataFrame) -> DataFrame:
    """fact, query, rec_ord, pos: the facts of the digests."""
    return records.select(F.col("ord").alias("rec_ord"), "query", F.posexplode("digest.facts").alias("pos", "fact")).select("fact", "query", "rec_ord", "pos")


def page_facts(docs: DataFrame, values: str = "items") -> DataFrame:
    """The same for what pages hold; the query says which page it was."""
    return docs.select(F.col("ord").alias("rec_ord"), F.concat(F.lit("deep-read: "), "url").alias("query"), F.posexplode(values).alias("pos", "fact")).select("fact", "query", "rec_ord", "pos")


def all_facts(records: DataFrame, docs: DataFrame | None = None, values: str = "items") -> DataFrame:
    """Facts of digests, then of pages: fact, query, src (0 or 1), rec_ord, pos, which order them."""
    d = digest_facts(records).withColumn("src", F.lit(0))
    return d.unionByName(page_facts(docs, values).withColumn("src", F.lit(1))) if docs is not None else d


def todo(queries: DataFrame, done: DataFrame, normalised: bool = False) -> DataFrame:
    """queries (ord, query) without those that have a record without an error; order and repeats stay. normalised: by query_key(),
    and then of queries with one key only the first stays."""
    finished = done.where("error is null") if "error" in done.columns else done
    if not normalised:
        return queries.join(finished.select("query").distinct(), "query", "left_anti").select(*queries.columns)
    key = X.query_key(F.col("query"))
    fresh = queries.withColumn("__key", key).join(finished.select(key.alias("__key")).distinct(), "__key", "left_anti")
    first = F.row_number().over(W.partitionBy("__key").orderBy("ord"))
    return fresh.withColumn("__n", first).where("__n = 1").select(*queries.columns)


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order, whole; empty and null keys go.

    min_by keeps one row per key before the exchange, so a key that holds a third of all rows moves as one row per task."""
    fields = F.struct(*rows.columns)
    picked = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(F.col(key).alias("__key")).agg(F.min_by(fields, F.struct(*order)).alias("r"))
    return picked.select("r.*")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place: 0, 1, ... in the given order. Rows are dealt by ranges, numbered inside each, and offset by the counts of the ranges before, so that no
    task orders them all; only the ranges' counts meet in one."""
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    d = saved(d, "placed").withColumn("__part", F.shiftrightunsigned("__id", 33))
    sizes = d.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # one row a partition
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return d.join(F.broadcast(offsets), "__part").withColumn("place", F.col("__before") + inside).drop("__part", "__id", "__before")


def cap(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most limit distinct values of key in first-seen order. Needs an ord column."""
    return first_seen(rows, key, ["ord"]).orderBy("ord").limit(limit)


def mean_relevance(records: DataFrame) -> DataFrame:
    """One row: mean relevance of the records with a digest, 0 if there are none."""
    return records.agg(F.coalesce(F.avg(F.when(F.col("digest").isNotNull(), F.coalesce("digest.relevance", F.lit(0.0)))), F.lit(0.0)).alias("mean_relevance"))


def counters(records: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: n_queries, n_sources (distinct URLs), n_facts."""
    n = records.agg(F.count("*").alias("n_queries"))
    s = hits(records).where(F.col("url") != "").agg(F.countDistinct("url").alias("n_sources"))
    return n.join(F.broadcast(s)).join(F.broadcast(facts.agg(F.count("*").alias("n_facts"))))  # one row each


def grounded_confidence(mean, deep, facts, k: int):
    """Confidence of a written answer, unrounded: relevance, share of the k pages read, and volume of facts. Columns in, column out."""
    share = F.least(F.lit(1.0), deep / F.lit(float(k)))
    volume = F.least(F.lit(1.0), facts / F.lit(40.0))
    return F.least(F.lit(0.9), F.lit(0.20) + F.lit(0.45) * mean + F.lit(0.20) * share + F.lit(0.15) * volume)


def list_confidence(corroborated, kept):
    """Confidence of a compiled list, unrounded; 0 for an empty one."""
    return F.when(kept > 0, F.least(F.lit(0.95), F.lit(0.35) + F.lit(0.6) * (corroborated / F.greatest(F.lit(1), kept)))).otherwise(0.0)


def census_confidence(n):
    return F.least(F.lit(0.95), F.lit(0.4) + n / F.lit(2000.0))

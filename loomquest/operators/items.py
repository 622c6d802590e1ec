"""Items of a list: corroboration across sources, and the census of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.functions import text as X
from loomquest.operators.records import list_confidence

LIST_CAP, FEW = 400, 25


def prefer_pages(facts: DataFrame) -> DataFrame:
    """Facts read from pages, or all facts if there are none of those."""
    deep = F.startswith("query", F.lit("deep-read:"))
    some = facts.agg(F.coalesce(F.max(deep.cast("int")), F.lit(0)).alias("__some"))
    return facts.join(F.broadcast(some)).where((F.col("__some") == 0) | deep).drop("__some")  # one row


def listable(facts: DataFrame) -> DataFrame:
    """facts that are items of a list, with item, and key (it in lower case)."""
    item = X.list_item(F.col("fact"))
    return X.held(facts, item=item, key=F.lower(item)).where(X.is_item(F.col("item"), F.col("key")))


def corroborated(facts: DataFrame, order: list[str]) -> DataFrame:
    """Distinct items without regard to case: item (as first seen), n_sources (distinct queries)."""
    return listable(facts).groupBy("key").agg(F.min_by("item", F.struct(*order)).alias("item"), F.countDistinct("query").alias("n_sources"))


def compiled_list(facts: DataFrame, order: list[str], cap: int = LIST_CAP) -> DataFrame:
    """rank, item, n_sources, n_corroborated, confidence: items on two or more sources first, then by name; items on one source only if fewer than
    25 are on more; at most cap items. confidence is that of the list, unrounded."""
    found = corroborated(facts, order)
    n = found.agg(F.count_if(F.col("n_sources") >= 2).alias("n_corroborated"))
    by = [F.col("n_sources").desc(), F.lower("item"), F.col("key")]
    kept = found.join(F.broadcast(n)).where((F.col("n_sources") >= 2) | (F.col("n_corroborated") < FEW)).orderBy(*by).limit(cap)  # n: one row
    ranked = kept.withColumn("rank", F.row_number().over(W.orderBy(*by)))
    total = F.count("*").over(W.partitionBy())
    return ranked.withColumn("confidence", list_confidence(F.col("n_corroborated"), total)).select("rank", "item", "n_sources", "n_corroborated", "confidence")


def mentions(found: DataFrame) -> DataFrame:
    """found: item, url, vetted, ord. The mentions that count, with their key."""
    item = X.trim(F.col("item"))
    v = X.held(found, item=item, low=F.lower(item)).where(X.is_mention(F.col("item"), F.col("low")))
    return X.held(v, key=X.mention_key(F.col("item"))).where(F.length("key").between(2, 60)).select("key", "item", "url", "vetted", "ord")


def census_list(mentioned: DataFrame) -> DataFrame:
    """item, sources, vetted, first per key: counts alone, so that no task gathers a common entity's pages."""
    return mentioned.groupBy("key").agg(F.min_by("item", "ord").alias("item"), F.countDistinct("url").alias("sources"), F.bool_or("vetted").alias("vetted"), F.min("ord").alias("first"))


def marked(found: DataFrame, held: DataFrame) -> DataFrame:
    """found (key, item, url, vetted, ord) with new: whether held, mentions of earlier rounds, lacks the pair of key and url."""
    pairs = held.select("key", "url").distinct().withColumn("__held", F.lit(True))
    return found.join(pairs, ["key", "url"], "left").withColumn("new", F.col("__held").isNull()).drop("__held")


def tally(found: DataFrame) -> DataFrame:
    """The state that a round adds, from marked() mentions: key, item, sources, vetted, first. sources counts new pairs alone, so states of rounds can be added up."""
    return found.groupBy("key").agg(
        F.min_by("item", "ord").alias("item"), F.countDistinct(F.when(F.col("new"), F.col("url"))).alias("sources"), F.bool_or("vetted").alias("vetted"), F.min("ord").alias("first")
    )


def merged(held: DataFrame, more: DataFrame) -> DataFrame:
    """The state of a census with that of one more round, key by key: a full outer merge of two tables of tally()'s columns. A merged census equals census_list() over all
    mentions. fresh: whether the key is new."""
    h, m = (d.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("item", "sources", "vetted", "first")]) for d, side in ((held, "h"), (more, "m")))
    old = F.col("m_first").isNull() | (F.col("h_first") <= F.col("m_first"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return h.join(m, "key", "full_outer").select(
        "key", F.when(old, F.col("h_item")).otherwise(F.col("m_item")).alias("item"), (count("h_sources") + count("m_sources")).alias("sources"),
        (F.coalesce("h_vetted", F.lit(False)) | F.coalesce("m_vetted", F.lit(False))).alias("vetted"), F.least("h_first", "m_first").alias("first"), F.col("h_first").isNull().alias("fresh"),
    )


def census_order():
    return [F.col("vetted").desc(), F.col("sources").desc(), F.col("first")]


def shown(item, sources, vetted):
    """item  (n), and a mark on those that no model vetted."""
    return F.concat(item, F.lit("  ("), sources.cast("string"), F.lit(")"), F.when(vetted, "").otherwise(" ~"))


def saturation(seen: DataFrame) -> DataFrame:
    """seen: round, key. Per round: new_items (keys not seen in an earlier round) and total_items so far. Rounds without new keys count too."""
    first = seen.groupBy("key").agg(F.min("round").alias("round"))
    new = first.groupBy("round").agg(F.count("*").alias("new_items"))
    rounds = seen.select("round").distinct().join(new, "round", "left").withColumn("new_items", F.coalesce("new_items", F.lit(0)).cast("long"))
    return rounds.withColumn("total_items", F.sum("new_items").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, 0)))

"""Ranking: sources for a goal, links worth following, top sources by relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.functions import goals
from loomquest.functions import text as X
from loomquest.operators.records import first_seen

TOP_K, DISCOVER_N = 8, 6


def _best(scored: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Per URL the row with the highest score, the earliest of equals, and first: where the URL stood first. One exchange, combined before it."""
    at = F.struct(*order)
    best = scored.groupBy("url").agg(F.max_by(F.struct("score", "overlap", *keep), F.struct("score", *[(-F.col(c)).alias(c) for c in order])).alias("b"), F.min(at).alias("first"))
    return best.select("url", "b.*", "first")


def rank_sources(hits: DataFrame, goal: str, k: int = TOP_K, enumerable: bool = False) -> DataFrame:
    """The k best sources: rank, url, title, snippet, source, score, overlap.

    score: 2 for each goal token found in title, snippet or URL (inside words too), plus the relevance of the record, plus 4 or 1.5 for titles of lists
    if the goal asks for one. Only sources with some overlap count, unless none has any. Equal scores: first seen first."""
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), "url")
    ov = X.overlap(goals.tokens(goal), hay)
    bonus = X.list_bonus(F.coalesce("title", F.lit("")), 4.0, 1.5) if enumerable else F.lit(0.0)
    scored = hits.where(F.col("url") != "").withColumn("overlap", ov).withColumn("score", F.col("overlap") * 2.0 + F.col("relevance") + bonus)
    best = _best(scored, ["rec_ord", "hit_ord"], ["title", "snippet", "source"])
    # Both candidates are short: the best k on topic, and the best k of all, which count only if the first is empty.
    order = [F.col("on_topic").desc(), F.col("score").desc(), F.col("first")]
    top = best.withColumn("on_topic", (F.col("overlap") > 0).cast("int")).orderBy(*order).limit(k)
    some = F.max("on_topic").over(W.partitionBy())
    top = top.withColumn("__some", some).where("on_topic = __some")
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "first"))).select("rank", "url", "title", "snippet", "source", "score", "overlap")


def discover_links(links: DataFrame, seen: DataFrame, goal: str, n: int = DISCOVER_N, enumerable: bool = False) -> DataFrame:
    """links: doc_ord, pos, url, anchor. The n best links not yet seen that may be followed and hold a goal token in anchor or URL: rank, url, title, score.

    score: 2 for each token, plus 3 or 1 for anchors of lists if the goal asks for one. A goal without tokens finds none."""
    tokens = goals.tokens(goal)
    anchor = F.coalesce("anchor", F.lit(""))
    ov = X.overlap(tokens, F.concat(anchor, F.lit(" "), "url"))
    bonus = X.list_bonus(anchor, 3.0, 1.0) if enumerable else F.lit(0.0)
    scored = links.where(X.followable(F.col("url"))).withColumn("overlap", ov).where("overlap > 0").withColumn("score", F.col("overlap") * 2.0 + bonus)
    best = _best(scored, ["doc_ord", "pos"], ["anchor"]).join(seen.select("url").distinct(), "url", "left_anti")
    top = best.orderBy(F.col("score").desc(), "first").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "first"))).select("rank", "url", F.col("anchor").alias("title"), "score")


def top_sources(hits: DataFrame, n: int = 10) -> DataFrame:
    """rank, url, title, source, relevance: each URL with the relevance of the record that had it first."""
    order = [F.col("relevance").desc(), F.col("rec_ord"), F.col("hit_ord")]
    top = first_seen(hits, "url", ["rec_ord", "hit_ord"]).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("rank", "url", "title", "source", "relevance")

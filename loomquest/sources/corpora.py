"""Documents of a corpus as what campaigns work on: hits and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 60


def as_hits(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """rec_ord, hit_ord, relevance, title, url, snippet, source: documents as hits, three to an address; quality as relevance, 0 without a label. The title is the text's head,
    the snippet all the rest of it."""
    d = documents.join(labels.select("doc_id", "quality"), "doc_id", "left")
    url = F.concat(F.lit("doc://"), "source", F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string"))
    return d.select(
        F.col("doc_id").alias("rec_ord"), F.lit(0).alias("hit_ord"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("relevance"),
        F.left("text", F.lit(HEAD)).alias("title"), url.alias("url"), F.substr("text", F.lit(HEAD + 1)).alias("snippet"), "source",
    )


def as_facts(documents: DataFrame) -> DataFrame:
    """doc_id, query, pos, fact: lines of documents as facts; the source is what found them."""
    return documents.select("doc_id", F.col("source").alias("query"), F.posexplode(F.split("text", "\n")).alias("pos", "fact"))

"""Quality rules: per-text measures and base rules, plus host-level verdicts.

Failures of the base rules are counted per host (the source of a document); each host's rate is shrunk with a
beta prior fitted to all hosts by the method of moments, and the host's verdict is joined back to its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import saved, sealed, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: A host whose shrunk rate of failures is above this is rejected whole.
HOST_LIMIT = 0.9
#: The host table is broadcast only up to this many rows; beyond it the join shuffles.
BROADCAST_HOSTS = 100_000


def _repeat_words(w: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by windows that occur twice or more. __m has the hash of the window at
    each position.

    Only rows with an equal pair of windows go on: their hashes are sorted with the positions, those with an equal neighbour are
    kept, and the union of their spans is measured in one pass over the sorted positions. Each step is a column of
    its own, so that no lambda evaluates it again."""
    pairs = F.transform("__m", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    w = w.withColumn("__r", F.when(F.size(F.array_distinct("__m")) < F.size("__m"), F.array_sort(pairs)).otherwise(F.filter(pairs, lambda x: F.lit(False))))
    near = lambda j: F.get(F.col("__r"), j)["h"]
    two = F.transform("__r", lambda x, j: F.when((near(j - 1) == x["h"]) | (near(j + 1) == x["h"]), x["i"]))
    w = w.withColumn("__p", F.array_sort(F.filter(two, lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("__p", start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))
    return w.withColumn("n_repeat_words", covered["n"].cast("long")).drop("__r", "__p")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed to every row.

    Null and empty texts have no words: all measures are 0 and base_failed is true. Columns of these names
    in the input are replaced."""
    w = docs.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__w", words(F.col("__text")))
    w = w.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    at = lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(WINDOW)])
    w = w.withColumn("__m", F.when(F.size("__w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), at)).otherwise(F.array().cast("array<bigint>")))
    # A line without a word is blank once white space is taken off.
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    w = w.withColumn("__l", lines)
    w = w.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        }
    )
    w = _repeat_words(w)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    w = w.withColumn("base_failed", failed).drop("__text", "__w", "__h", "__m", "__l")
    return sealed(w, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host (null is a host of its own): host, n, failed, rate (shrunk), rejected.

    The prior's mean and strength come from the mean and variance of the hosts' raw rates. With fewer than two
    hosts, or when the rates spread more than a beta law can, the prior is one pseudo-document."""
    by = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    stats = by.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("v") < F.col("m") * (1 - F.col("m"))), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1.0))
    prior = stats.select("m", F.greatest(strength, F.lit(1.0)).alias("k"))
    shrunk = by.join(F.broadcast(prior))  # one row
    return shrunk.select("host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate")).withColumn("rejected", F.col("rate") > limit)


def with_verdicts(measured: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Joins host verdicts to the rows of measured: host_rate and kept. The small table of hosts is broadcast after
    a look at its size; a larger one is joined by a shuffle."""
    hosts = hosts.select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), F.col("rejected").alias("__rejected"))
    few = hosts.count() <= BROADCAST_HOSTS
    out = measured.drop("host_rate").join(F.broadcast(hosts) if few else hosts, F.col(host).eqNullSafe(F.col("__host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("__rejected", F.lit(False))).drop("__host", "__rejected")


def judged(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """All rows and columns of docs with measures(), host_rate and kept: false if the base rules fail, else the
    verdict on the host. Repeated rows are judged alike; an empty table gives an empty table.

    Texts are measured once: the measured rows are written to the shared folder, where the hosts' counts read two narrow columns and the verdicts join the
    rows, so that no text is shuffled."""
    m = saved(measures(docs, text), "measured")
    return with_verdicts(m, saved(host_verdicts(m, host, limit), "hosts"), host)

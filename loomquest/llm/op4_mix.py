"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums
of word counts and a cut at each source's exact budget, with whole epochs before the cut where needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.llm.common import WORD, saved, words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its own size.
MAX_EPOCHS = 3
SEED = 20
#: Rows of a source in one range of keys, about; sets how many ranges there are.
ROWS_A_RANGE = 200_000


def budgets(by_source: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """by_source: source, source_size. Adds target (double) by water-filling: each source gets its
    weight's share of all words, those above max_epochs times their size stop there, and what is over goes to the rest by weight.

    One row per source is all that is sorted here; null sorts last. Sources of size 0 get 0."""
    last = [F.col("source").isNull(), F.col("source")]
    rank = F.row_number().over(W.orderBy(*last)) - 1
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    s = by_source.withColumn("w", weight).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    # In order of cap / weight, the sources before the level are full; the level is what the rest share per weight.
    order = W.orderBy((F.col("cap") / F.col("w")), *last)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    # The level at the first source that is not full holds for all after it.
    s = s.withColumn("final", F.min(F.struct((~F.col("open")).alias("full"), (F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.col("final"))
    return s.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, text: str = "text", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Columns of docs plus size, source_size, target and taken (words that the mix takes, repeats counted).

    Each source's rows stand in the order of md5(seed:doc_id); whole epochs come first, then the order is
    cut where the rest of the budget (rounded down to a word) ends, inside a document if need be. Rows that repeat a doc_id stand
    side by side (ties fall to the text's hash, and equal rows share nothing: each is cut in turn).
    Null text: size 0, taken 0. Null source: a source of its own. An empty table gives an empty table."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = docs.drop("size", "source_size", "target", "taken").withColumns({"size": size, "__key": key})
    # One non-null key for the source serves the window and the join, so both use one exchange.
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = docs.select("doc_id").count()
    digits = 2
    while 16**digits * rows_a_range < rows:
        digits += 1
    part = F.substring("__key", 1, digits)
    d = d.withColumns({"__name": name, "__range": part})
    # Sums by (source, range of keys), made map-side before they move; the prefix over ranges is a running sum of those.
    ranges = d.groupBy("__name", "__range").agg(F.sum("size").alias("__words"), F.first("source").alias("source"))
    ranges = saved(ranges, "ranges")
    offsets = ranges.withColumn("__before", F.coalesce(F.sum("__words").over(W.partitionBy("__name").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goals = budgets(ranges.groupBy("__name").agg(F.first("source").alias("source"), F.sum("__words").alias("source_size")), weights, max_epochs)
    plan = offsets.select("__name", "__range", "__before").join(goals.select(name.alias("__name"), "source_size", "target"), "__name")
    order = W.partitionBy("__name", "__range").orderBy("__key", "__tie").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__tie", F.xxhash64(text)).withColumn("__in", F.sum("size").over(order))
    d = d.join(plan, ["__name", "__range"])
    start = F.col("__before") + F.coalesce("__in", F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return d.withColumn("taken", taken.cast("long")).drop("__key", "__range", "__name", "__tie", "__in", "__before")


def mix_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken whole, and the one
    at each source's cut once more with its first words, joined by spaces, if the cut falls inside it. n_chars, where there is one, follows the text."""
    m = mixed(docs, **how)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    pieces = F.flatten(F.array(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>"))))
    out = m.withColumn("__piece", F.explode(pieces))
    cut = F.when(F.col("__piece") < 0, F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), F.greatest("__piece", F.lit(0))), " "))
    out = out.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

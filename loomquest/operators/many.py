"""Sources for a table of goals: what rank.rank_sources() does for one goal, for many in two passes over the hits.

The tokens of all goals are one automaton, so a hit's text is read once however many goals there are, and an inverted list leads from a token to its goals. Pairs of hits and
goals are never a table: the first pass keeps the k best scores of each goal in each task, which gives each goal's k-th best score over all; the second lets only hits pass that reach
it. Where each address stood first is looked up for those alone. Goals are taken in blocks of about MOST_TOKENS tokens, each block against all hits."""

from __future__ import annotations

from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.functions import text as X
from loomquest.operators.rank import TOP_K, rank_sources
from loomquest.sources.tables import saved

#: Tokens of the goals of a block, about, and cells (hits by goals) that a task scores at a time.
MOST_TOKENS, CELLS = 200_000, 2_000_000
_TOKEN = itemgetter(1)
_BEST = "goal int, url string, score double"
_REACHED = "goal int, url string, score double, overlap int, rec_ord long, hit_ord int"


class _Index:
    """The goals that hold each token, found in texts by one automaton."""

    def __init__(self, tokens: list[list[str]], listing: list[bool]):
        self.listing, self.n = np.array(listing, float), len(tokens)
        goals: dict[str, list[int]] = {}
        for g, own in enumerate(tokens):
            for t in own:
                goals.setdefault(t, []).append(g)
        self.sizes = np.fromiter(map(len, goals.values()), np.int64, len(goals))
        self.start, self.goals = np.cumsum(self.sizes) - self.sizes, np.fromiter(chain.from_iterable(goals.values()), np.int64)
        self.finder = ahocorasick.Automaton()
        for i, t in enumerate(goals):
            self.finder.add_word(t, i)
        self.finder.make_automaton()

    def overlaps(self, texts: list[str]) -> np.ndarray:
        """How many of each goal's tokens each text holds, as parts of words too."""
        out = np.zeros((len(texts), self.n), np.int32)
        step = max(1, CELLS // max(1, self.n, len(self.goals)))
        for at in range(0, len(texts) if len(self.goals) else 0, step):
            part = out[at : at + step]
            found = [set(map(_TOKEN, self.finder.iter(t))) for t in texts[at : at + step]]
            token = np.fromiter(chain.from_iterable(found), np.int64)
            row, many = np.repeat(np.arange(len(part)), np.fromiter(map(len, found), np.int64, len(part))), self.sizes[token]
            goal = self.goals[np.repeat(self.start[token] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            part[:] = np.bincount(np.repeat(row, many) * self.n + goal, minlength=part.size).reshape(part.shape)
        return out

    def scored(self, batches):
        """(rows, overlap, score), hits by goals; a score without overlap is minus infinity."""
        step = max(1, CELLS // max(1, self.n))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                overlap = self.overlaps(rows["hay"].to_pylist())
                base = rows["relevance"].to_numpy()[:, None] + rows["bonus"].to_numpy()[:, None] * self.listing
                yield rows, overlap, np.where(overlap > 0, overlap * 2.0 + base, -np.inf)


def _best(index, k: int):
    """The k best addresses of each goal in a task, by score."""

    def run(batches):
        own, goal, url, score = _Index(*index.value), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        for rows, _, s in own.scored(batches):
            names, code = np.unique(rows["url"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
            order = np.argsort(code, kind="stable")
            per = np.maximum.reduceat(s[order], np.searchsorted(code[order], np.arange(len(names))), axis=0)
            if len(names) > k:  # only what is among the k best of these rows can be among the k best of all
                per[per < np.partition(per, len(names) - k, axis=0)[len(names) - k]] = -np.inf
            u, g = np.nonzero(per > -np.inf)
            goal, url, score = np.concatenate([goal, g]), np.concatenate([url, names[u]]), np.concatenate([score, per[u, g]])
            _, same = np.unique(url, return_inverse=True)
            order = np.lexsort((-score, same, goal))  # one row for each goal and address, then k rows for each goal
            first = np.ones(len(order), bool)
            first[1:] = (goal[order][1:] != goal[order][:-1]) | (same[order][1:] != same[order][:-1])
            order = order[first]
            order = order[np.lexsort((-score[order], goal[order]))]
            place = np.arange(len(order)) - np.searchsorted(goal[order], goal[order])
            order = order[place < k]
            goal, url, score = goal[order], url[order], score[order]
        yield pa.RecordBatch.from_arrays([pa.array(goal, pa.int32()), pa.array(url, pa.string()), pa.array(score, pa.float64())], names=["goal", "url", "score"])

    return run


def _reached(index, least):
    """Hits that reach the score of each goal's k-th best address."""

    def run(batches):
        for rows, overlap, s in _Index(*index.value).scored(batches):
            h, g = np.nonzero((s > -np.inf) & (s >= least.value))
            take = pa.array(h)
            arrays = [pa.array(g, pa.int32()), rows["url"].take(take), pa.array(s[h, g]), pa.array(overlap[h, g]), rows["rec_ord"].take(take), rows["hit_ord"].take(take)]
            yield pa.RecordBatch.from_arrays(arrays, names=["goal", "url", "score", "overlap", "rec_ord", "hit_ord"])

    return run


def _block(hits: DataFrame, thin: DataFrame, goals: list, k: int) -> DataFrame:
    spark = hits.sparkSession
    index = spark.sparkContext.broadcast(([list(g["__tokens"]) for g in goals], [bool(g["listing"]) for g in goals]))
    best = thin.mapInArrow(_best(index, k), _BEST).groupBy("goal", "url").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("goal").orderBy(F.col("score").desc()))
    top = best.withColumn("place", place).where(F.col("place") <= k).groupBy("goal").agg(F.min("score").alias("least")).collect()  # one row a goal of the block
    least = np.full(len(goals), np.inf)
    for r in top:
        least[r.goal] = r.least
    reached = thin.mapInArrow(_reached(index, spark.sparkContext.broadcast(least)), _REACHED)
    at = F.struct("rec_ord", "hit_ord")
    found = saved(reached.groupBy("goal", "url").agg(F.max_by(F.struct("score", "overlap", "rec_ord", "hit_ord"), F.struct("score", -F.col("rec_ord"), -F.col("hit_ord"))).alias("b")), "reached")
    first = hits.join(found.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min(at).alias("first"))
    order = W.partitionBy("goal").orderBy(F.col("b.score").desc(), "first")
    ranked = found.join(first, "url").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, g["goal_id"]) for i, g in enumerate(goals)], "goal int, goal_id long")
    return saved(ranked.join(F.broadcast(ids), "goal").select("goal_id", "rank", "url", "b.score", "b.overlap", "b.rec_ord", "b.hit_ord"), "ranked")


def rank_for_goals(hits: DataFrame, goals: DataFrame, k: int = TOP_K) -> DataFrame:
    """goals: goal_id long, goal, listing (whether titles of lists gain). The k best sources of each: goal_id, rank, url, title, snippet, source, score, overlap, by the rules of
    rank_sources(): hits is a table as it takes, with one row for each rec_ord and hit_ord. A goal that no source is on topic for gets the best of all.

    Hits without an address count nowhere. Null goals and those without tokens are on topic nowhere; goals that repeat an id count once; an empty table of either gives no rows."""
    h = hits.where(F.col("url") != "")
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), "url"))
    thin = h.select("url", hay.alias("hay"), "relevance", X.list_bonus(F.coalesce("title", F.lit("")), 4.0, 1.5).alias("bonus"), "rec_ord", "hit_ord")
    asked = goals.dropDuplicates(["goal_id"]).select("goal_id", F.coalesce("listing", F.lit(False)).alias("listing"), X.goal_tokens(F.col("goal")).alias("__tokens"))
    blocks = max(1, -(-int(asked.agg(F.coalesce(F.sum(F.size("__tokens")), F.lit(0))).first()[0]) // MOST_TOKENS))
    parts = []
    for b in range(blocks):  # a stated set of goals against all hits, block by block
        mine = asked.where(F.pmod(F.xxhash64("goal_id"), F.lit(blocks)) == b).orderBy("goal_id").collect()
        if mine:
            parts.append(_block(h, thin, mine, k))
    if not parts:
        return hits.sparkSession.createDataFrame([], "goal_id long, rank int, url string, title string, snippet string, source string, score double, overlap int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    whole = h.select("rec_ord", "hit_ord", "title", "snippet", "source")
    columns = ["goal_id", "rank", "url", "title", "snippet", "source", "score", "overlap"]
    on = found.join(whole, ["rec_ord", "hit_ord"]).select(*columns)
    # Goals off every topic: one short list for those that ask for lists, one for the others, if there are such goals.
    off = saved(asked.join(found.select("goal_id").distinct(), "goal_id", "left_anti").select("goal_id", "listing"), "off")
    for x in sorted(r["listing"] for r in off.select("listing").distinct().collect()):
        usual = rank_sources(h, "", k, x)
        on = on.unionByName(off.where(F.col("listing") == x).join(F.broadcast(usual)).select(*columns))
    return on

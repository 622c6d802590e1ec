"""The census: every mention of an entity, in rounds until hardly anything new comes. State lives in tables, so a later run goes on."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquest.functions import goals
from loomquest.functions import text as X
from loomquest.models import tasks
from loomquest.operators import items, rank, records
from loomquest.plans import lock, report
from loomquest.plans.engine import Engine, link_rows
from loomquest.sources import backends as B
from loomquest.operators.records import placed
from loomquest.sources.sink import mark
from loomquest.sources.tables import saved, there
from loomquest.streaming.census import CensusTable


@dataclass(frozen=True)
class Scope:
    """Rounds at most, queries of the first and later rounds, pages read and links followed a round, hits a backend, and the new items below which it stops."""

    rounds: int
    first: int
    later: int
    pages: int
    follow: int
    per_backend: int
    least_new: int


#: Findings that the corpus in hand holds; its file has all of them.
SPOKEN = 100

# Fixed values.
SCOPES = {"broad": Scope(2, 12, 10, 10, 8, 6, 15), "exhaustive": Scope(5, 18, 14, 12, 12, 8, 8)}
STATE = {"queries": "query string, round int", "urls": "url string, round int"}


def counted(engine: Engine, slug: str) -> CensusTable:
    """The mentions of a census and its merged state, a batch a round."""
    return CensusTable(engine.spark, f"{engine.folder}/{slug}.census/counted")


def _tables(engine: Engine, slug: str) -> dict[str, str]:
    return {k: f"{engine.folder}/{slug}.census/{k}" for k in STATE}


def state(engine: Engine, slug: str) -> dict[str, DataFrame]:
    """The tables of a census so far: queries asked, pages read. Empty for a new one."""
    out = {}
    for k, path in _tables(engine, slug).items():
        out[k] = engine.spark.read.schema(STATE[k]).parquet(path) if there(engine.spark, path) else engine.spark.createDataFrame([], STATE[k])
    return out


def _adopt(engine: Engine, slug: str) -> None:
    """Makes the state of a census from its corpus file where there is one and no table: items with as many sources as it counts (their addresses are not in it), queries
    and pages."""
    file, spark = report.paths(engine.folder, slug)["json"], engine.spark
    if not file.is_file():
        return
    corpus = json.loads(file.read_text(encoding="utf-8"))
    if corpus.get("mode") != "census":
        return
    rows = [(i, x.get("item") or "", max(1, int(x.get("sources") or 1)), bool(x.get("vetted"))) for i, x in enumerate(corpus.get("items") or [])]
    d = spark.createDataFrame(rows, "ord long, item string, n int, vetted boolean").withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
    counted(engine, slug).add(d.select("item", F.format_string("prior:%d/%d", "ord", "k").alias("url"), "vetted", "ord"), 0)
    made = {
        "queries": spark.createDataFrame([(q, 0) for q in corpus.get("done_queries") or []], STATE["queries"]),
        "urls": spark.createDataFrame([(u, 0) for u in corpus.get("seen_urls") or []], STATE["urls"]),
    }
    for k, path in _tables(engine, slug).items():
        made[k].write.mode("append").parquet(path)


def _round(engine: Engine, goal: str, entity: str, scope: Scope, names: list[str], fresh: DataFrame, seen: DataFrame, number: int):
    """Searches, reads and follows links once. Returns hits, pages, and what may be mentions, with its order."""
    hits = engine.search(fresh, names, scope.per_backend)
    ranked = rank.rank_sources(hits.select(F.col("ord").alias("rec_ord"), "hit_ord", "title", "url", "snippet", "source", F.lit(1.0).alias("relevance")), goal, scope.pages, True)
    docs = engine.read(ranked.join(seen.select("url"), "url", "left_anti"), scope.pages, True, True)
    known = seen.select("url").union(docs.select("url"))
    more = rank.discover_links(link_rows(docs), known, goal, scope.follow, True)
    docs = saved(docs.unionByName(engine.read(more, scope.follow, True, False, scope.pages)), "docs")
    told = tasks.page_mentions(docs, entity, engine.client, engine.model).select("ord", "url", F.posexplode("found").alias("pos", "item"), F.lit(True).alias("vetted"))
    listed = docs.select("ord", "url", F.posexplode("items").alias("pos", "item"), F.lit(False).alias("vetted"))
    place = (F.lit(number).cast("long") * 2**40 + F.col("ord") * 2**20 + F.when(F.col("vetted"), 2**19).otherwise(0) + F.col("pos")).cast("long")
    return hits, docs, listed.unionByName(told).withColumn("ord", place).select("item", "url", "vetted", "ord")


def run(engine: Engine, goal: str, slug: str | None = None, scope: str = "broad", names: list[str] | None = None, resume: bool = True) -> dict:
    """A census under the lock. Rounds end when no query is new, or a round after the first finds fewer new items than its scope asks. Returns the corpus."""
    slug, names, s = slug or goals.slug(goal), names or B.resolve([]), SCOPES.get(scope, SCOPES["broad"])
    entity, spark, paths = goals.entity(goal), engine.spark, None
    with lock.held(engine.folder, slug):
        paths = _tables(engine, slug)
        if not resume:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{engine.folder}/{slug}.census")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        elif not there(spark, paths["queries"]):
            _adopt(engine, slug)
        before = state(engine, slug)
        last = before["queries"].agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
        wanted = goals.facet_queries(goal, s.first, tasks.expanded(engine.client, goal, s.first))
        log, hits_of, table = [], [], counted(engine, slug)
        for turn in range(s.rounds):
            number, held = last + turn + 1, state(engine, slug)
            fresh = records.todo(spark.createDataFrame(list(enumerate(wanted)), "ord long, query string"), held["queries"], normalised=True)
            fresh = saved(fresh, "fresh")
            if fresh.isEmpty():
                break
            hits, docs, found = _round(engine, goal, entity, s, names, fresh, held["urls"], number)
            n = table.add(found, number)
            new, now = n["fresh"], n["items"]
            docs.select("url", F.lit(number).alias("round")).write.mode("append").parquet(paths["urls"])
            fresh.select("query", F.lit(number).alias("round")).write.mode("append").parquet(paths["queries"])
            hits_of.append(hits)
            log.append({"query": f"round {number}", "round": number, "n_results": hits.count(), "pages_read": docs.count(), "new_items": new, "total_items": now,
                        "digest": {"relevance": 1.0}, "results": [r.asDict() for r in hits.orderBy("ord", "hit_ord").limit(40).select("title", "url", "snippet", "source").collect()]})
            report.add_round(engine.folder, slug, log[-1])
            engine.say(f"round {number}: {now} items, {new} of them new")
            if turn and new < s.least_new:
                break
            if turn < s.rounds - 1:
                done = [r.query for r in state(engine, slug)["queries"].limit(60).collect()]
                known = [r.item for r in table.census().limit(40).collect()]
                asked = tasks.widened(engine.client, entity, known, done, s.later, engine.model)
                keys = {r.k for r in state(engine, slug)["queries"].select(X.query_key(F.col("query")).alias("k")).collect()} if asked else set()
                asked = [q for q in asked if " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in q.lower()).split()) not in keys]
                wanted = asked or goals.facet_queries(f"{goal} facet {turn + 2}", s.later)
        return _finished(engine, goal, slug, scope, entity, names, log, hits_of)


def _finished(engine: Engine, goal: str, slug: str, scope: str, entity: str, names: list[str], log: list[dict], hits_of: list[DataFrame]) -> dict:
    held = state(engine, slug)
    listed = placed(counted(engine, slug).census().withColumns({"__v": F.when(F.col("vetted"), 0).otherwise(1), "__s": -F.col("sources")}), ["__v", "__s", "first"])
    listed = saved(listed.withColumn("shown", items.shown(F.col("item"), F.col("sources"), F.col("vetted"))), "items")
    n, vetted = listed.agg(F.count("*"), F.count_if("vetted")).first()
    n_asked, rounds = held["queries"].agg(F.count("*"), F.coalesce(F.max("round"), F.lit(0))).first()
    some = [h.select(F.lit(i).alias("turn"), "ord", "hit_ord", "title", "url", "snippet", "source") for i, h in enumerate(hits_of)]
    sources = saved(records.first_seen(reduce(DataFrame.unionByName, some), "url", ["turn", "ord", "hit_ord"]), "sources") if some else engine.spark.createDataFrame([], "turn int, ord long, hit_ord int, title string, url string, snippet string, source string")
    where = ["turn", "ord", "hit_ord"]
    top = [r.asDict() for r in sources.orderBy(*where).limit(12).select("title", "url", "snippet", "source").collect()]
    asked = placed(held["queries"].select("query"), ["query"])
    seen = placed(held["urls"].select("url").distinct(), ["url"])
    told = (
        f"{n} names for \"{entity}\", gathered in {rounds} rounds of {n_asked} queries at scope {scope}. The {vetted} that a model confirmed stand first; a ~ marks those read off lists and tables only. "
        "The number behind a name counts the pages that have it."
    )
    # The keys of a corpus file.
    corpus = {
        "slug": slug, "goal": goal, "mode": "census", "scope": scope, "entity": entity, "backends": names, "engine": engine.client.label, "safety": engine.safety(),
        "n_queries": n_asked, "n_rounds": rounds, "n_sources": sources.count(), "n_deep_read": sum(r["pages_read"] for r in log), "n_discovered": 0,
        "n_facts": n, "n_items": n, "n_vetted": vetted, "done_queries": mark("done_queries"), "seen_urls": mark("seen_urls"),
        "queries": [r["query"] for r in log], "records": mark("records"), "sources": mark("sources"), "facts": mark("facts"), "items": mark("items"),
        "report": {"answer": told, "key_findings": mark("found"), "open_questions": [], "confidence": round(min(0.95, 0.4 + n / 2000), 2), "enumerated": True},
    }
    rows_of = engine.spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(log)], "k0 long, value string")  # one a round
    sections = [
        rows_of.select(F.lit("records").alias("section"), "k0", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "value"),
        report.values("sources", sources, where, F.struct("title", "url", "snippet", "source")),
        report.values("items", listed, ["place"], F.struct("item", "sources", "vetted")),
        report.values("facts", listed, ["place"], F.struct(F.col("item").alias("fact"), F.concat(F.lit("census x"), "sources").alias("query"))),
        report.values("found", listed, ["place"], F.col("shown")),
        report.values("done_queries", asked, ["place"], F.col("query")),
        report.values("seen_urls", seen, ["place"], F.col("url")),
    ]
    corpus = report.write(engine.folder, corpus, sections, top, n)
    corpus["report"] = corpus["report"] | {"key_findings": [r.shown for r in listed.orderBy("place").limit(SPOKEN).select("shown").collect()]}
    corpus["top"] = top
    return corpus

"""The quick campaign: queries, hits, digests, pages, links, facts, report. A log of records makes it resumable."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquest.functions import goals
from loomquest.functions import text as X
from loomquest.models import tasks
from loomquest.operators import items, rank, records
from loomquest.plans import lock, report
from loomquest.plans.engine import Engine, fanned, link_rows, with_summaries
from loomquest.sources import backends as B
from loomquest.sources import cache, files, transport
from loomquest.sources.sink import mark
from loomquest.sources.tables import saved, there
from loomquest.streaming import live


def queries_for(engine: Engine, seed: str, n: int = 24) -> list[str]:
    return goals.facet_queries(seed, n, tasks.expanded(engine.client, seed, n))


def harvest(engine: Engine, queries: list[str], slug: str, goal: str, names: list[str], per_backend: int = 6, distil: bool = True, wave: int = 12) -> DataFrame:
    """Adds a record for each query that the log lacks, wave by wave, and returns the log. What a wave has found is durable before the next begins."""
    spark, log = engine.spark, f"{engine.folder}/{slug}.jsonl"
    wanted = spark.createDataFrame(list(enumerate(queries)), "ord long, query string")
    left = [tuple(r) for r in records.todo(wanted, files.record_log(spark, log)).orderBy("ord").collect()]
    for at in range(0, len(left), wave):
        part = spark.createDataFrame(left[at : at + wave], "ord long, query string")
        found = _records(engine, part, engine.search(part, names, per_backend), goal, distil)
        engine.say(f"{min(at + wave, len(left))} of {len(left)} queries asked")
        files.append_records(saved(found, "records"), log)
    return files.record_log(spark, log)


def harvest_live(engine: Engine, queries: list[str], slug: str, goal: str, names: list[str], per_backend: int = 6, distil: bool = True) -> DataFrame:
    """As harvest(), but as a stream: each host's requests wait in its state for their turn, and a record is in the log when the last answer to its query is. A call after one
    that broke goes on with the stream as it was: what was answered is not asked again, and hosts keep their gaps and counters.

    The stream's folder is slug.live/N; N grows when all queries of the one before have their records."""
    spark, log, n = engine.spark, f"{engine.folder}/{slug}.jsonl", per_backend
    wanted = spark.createDataFrame(list(enumerate(queries)), "ord long, query string")
    left = saved(records.todo(wanted, files.record_log(spark, log)), "todo")
    total = left.count()
    if not total:
        return files.record_log(spark, log)
    number, held = _live_folder(engine, slug, left)
    folder = f"{engine.folder}/{slug}.live/{number}"
    asked = left.join(held.select("query").distinct(), "query", "left_anti").select("ord", "query").withColumn("q", X.build_query(F.col("query"), None))
    addresses = {b: {transport.netloc(r.url) for r in B.BACKENDS[b].requests("q", n, engine.settings)} for b in names}
    site = live.sites(names, addresses)
    one = F.struct("url", "method", "form", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    fans = fanned(asked, names, n, engine.settings).withColumn("key", cache.key(F.col("backend"), F.col("q"), F.lit(n)))
    tries = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("try_ord", F.to_json(one).alias("r")))), lambda x: x["r"]))
    fans = saved(fans.groupBy("ord", "query", "backend_ord", "backend", "key").agg(tries.alias("tries")), "requests")
    kept = saved(cache.read(spark, engine.cache_path, keys=fans), "cached") if engine.cache_path else spark.createDataFrame([], "key string, body string")
    at = F.create_map(*[F.lit(x) for b in names for x in (b, site[b])])
    # Answers of the cache are those of a batch before the first, one for each call.
    known = fans.join(kept, "key").select("ord", "query", "backend_ord", "backend", "key", F.lit("").alias("address"), "body", F.lit(0).alias("more"), *[F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("sent", "int"), ("blocks", "int"), ("gap", "double"), ("tripped", "boolean"))])
    known.write.mode("overwrite").parquet(f"{folder}/answers/batch=-{uuid.uuid4().int >> 66}")
    rest = cache.misses(fans, kept)
    rest.select(at[F.col("backend")].alias("site"), "ord", "query", "backend_ord", "backend", "key", "tries").coalesce(1).write.mode("append").json(f"{folder}/requests")

    def record(batch: int) -> bool:
        """Adds the records of queries that have all their answers and no record yet; whether none is left."""
        rows = live.answers(spark, f"{folder}/answers")
        engine.states |= transport.host_states(rows.where("host is not null"))
        main = rows.where(F.col("backend").isin(names))
        per = rows.groupBy("ord", "query").agg(F.countDistinct(F.when(F.col("backend").isin(names), F.col("backend_ord"))).alias("have"), F.sum("more").alias("more"), F.count_if(F.col("backend") == "wiki:summary").alias("came"))
        ready = saved(records.todo(per.where((F.col("have") == len(names)) & (F.col("came") >= F.col("more"))).select("ord", "query"), files.record_log(spark, log)), "ready")
        if not ready.isEmpty():
            hits = saved(B.parsed(main.join(ready.select("ord"), "ord", "left_semi").select("ord", "query", "backend_ord", "backend", "body"), n), "rows")
            told = rows.where(F.col("backend") == "wiki:summary").select(F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.substring_index("address", live.SUMMARY, -1)).alias("url"), F.from_json("body", "extract string")["extract"].alias("__extract")).dropDuplicates(["url"])
            files.append_records(saved(_records(engine, ready, B.gathered(with_summaries(hits, told)), goal, distil), "records"), f"{log}/{number}-{batch}", again=True)
            if engine.cache_path:
                fresh = main.join(hits.select("ord", "backend_ord").distinct(), ["ord", "backend_ord"], "left_semi").where("host is not null").select("key", "body").dropDuplicates(["key"])
                cache.store(cache.misses(fresh, cache.read(spark, engine.cache_path, keys=fresh)), engine.cache_path)
        gone = total - records.todo(left, files.record_log(spark, log)).count()
        engine.say(f"{gone} of {total} queries asked")
        return gone == total

    gate = live.Gate(engine.transport, B.POLICIES, dict(engine.states), n)
    if not record(-1):  # the cache may have had it all, or an earlier call all answers but not all records
        live.run(spark, folder, gate, len(set(site.values())), record)
    return files.record_log(spark, log)


def _live_folder(engine: Engine, slug: str, left: DataFrame) -> tuple[int, DataFrame]:
    """The number of the stream to go on with and the requests that it holds: the last one if some query that is left is among its requests, else a new one."""
    spark, number = engine.spark, 0
    while there(spark, f"{engine.folder}/{slug}.live/{number}/requests"):
        held = spark.read.schema(live.REQUEST).json(f"{engine.folder}/{slug}.live/{number}/requests")
        if not left.join(held.select("query"), "query", "left_semi").isEmpty():
            return number, held
        number += 1
    return number, spark.createDataFrame([], live.REQUEST)


def _records(engine: Engine, asked: DataFrame, found: DataFrame, goal: str, distil: bool) -> DataFrame:
    """A record for each of asked (ord, query) from its hits."""
    hit = F.struct("title", "url", "snippet", "source")
    found = found.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("hit_ord", hit.alias("h")))), lambda x: x["h"]).alias("results"))
    r = asked.join(found, "ord", "left").withColumn("results", F.coalesce("results", F.array().cast(f"array<{records.HIT}>")))
    r = r.withColumn("n_results", F.size("results"))
    r = tasks.distilled(r, goal, engine.client, engine.model) if distil else r.withColumn("digest", F.lit(None).cast(records.DIGEST))
    return r.select("ord", "query", "n_results", "digest", "results", F.lit(None).cast("string").alias("error"))


def consolidate(engine: Engine, log: DataFrame, slug: str, goal: str, names: list[str], queries: list[str] | None = None, synth: bool = True, deep: bool = True, discover: bool = True) -> dict:
    """Folds a log into a corpus: reads the best pages where that helps, compiles or writes the answer, and writes the files. Returns the corpus."""
    hits = saved(records.hits(log), "hits")
    listing = goals.is_enumerable(goal)
    sources = records.first_seen(hits, "url", ["rec_ord", "hit_ord"])
    docs, n_found = None, 0
    if deep and (listing or engine.client.works) and not sources.isEmpty():
        docs = engine.read(rank.rank_sources(hits, goal, rank.TOP_K, listing), rank.TOP_K, listing, discover)
        if discover and not docs.isEmpty():
            more = rank.discover_links(link_rows(docs), docs, goal, rank.DISCOVER_N, listing)
            found = engine.read(more, rank.DISCOVER_N, listing, False, rank.TOP_K)
            n_found, docs = found.count(), docs.unionByName(found)
        if not listing:
            docs = saved(tasks.page_facts(docs, goal, engine.client, False, engine.model), "read")
    facts = saved(records.all_facts(log, docs, "items" if listing else "found"), "facts")
    order = ["src", "rec_ord", "pos"]
    n = records.counters(log, facts).first()
    n_deep = docs.count() if docs is not None else 0
    corpus = {
        "slug": slug, "goal": goal, "backends": names, "engine": engine.client.label, "safety": engine.safety(),
        "n_queries": n.n_queries, "n_sources": n.n_sources, "n_deep_read": n_deep, "n_discovered": n_found, "n_facts": n.n_facts,
        "records": mark("records"), "sources": mark("sources"), "facts": mark("facts"), "queries": queries or mark("queries"),
    }
    corpus["report"] = _answer(engine, facts, order, goal, log, n_deep, n.n_facts, listing) if synth and n.n_facts else None
    top = [r.asDict() for r in (rank.rank_sources(hits, goal, 12, listing) if goal else rank.top_sources(hits, 12)).orderBy("rank").collect()]
    sections = [
        report.values("records", log, ["ord"], F.struct(*log.columns)),
        report.values("sources", sources, ["rec_ord", "hit_ord"], F.struct("title", "url", "snippet", "source")),
        report.values("facts", facts, order, F.struct("fact", "query")),
        report.values("queries", log, ["ord"], F.col("query")),
    ]
    corpus = report.write(engine.folder, corpus, sections, top)
    corpus["top"] = top
    return corpus


def _answer(engine: Engine, facts: DataFrame, order: list[str], goal: str, log: DataFrame, n_deep: int, n_facts: int, listing: bool) -> dict | None:
    if listing:
        rows = items.compiled_list(items.prefer_pages(facts), order).orderBy("rank").collect()
        many = rows[0].n_corroborated if rows else 0
        text = f"{len(rows)} entries answer \"{goal}\"; {many} of them stand in two or more sources and come first."
        return {"answer": text, "key_findings": [r.item for r in rows], "open_questions": [], "confidence": round(rows[0].confidence, 2) if rows else 0.0, "enumerated": True}
    r = tasks.synthesised(records.placed(facts.select("fact", *order), order), goal, engine.client, engine.model)
    if r:
        c = records.mean_relevance(log).select(records.grounded_confidence(F.col("mean_relevance"), F.lit(n_deep), F.lit(n_facts), rank.TOP_K)).first()[0]
        r["confidence"] = round(c, 2)
    return r


def run(engine: Engine, seed: str, slug: str | None = None, queries: list[str] | None = None, goal: str | None = None, names: list[str] | None = None, n: int = 24, per_backend: int = 6, distil: bool = True, synth: bool = True, deep: bool = True, discover: bool = True, streamed: bool = False) -> dict:
    """A whole quick campaign under the lock. The same slug goes on where it stopped. streamed: queries are asked by harvest_live(), else in waves."""
    goal, slug = goal if goal is not None else seed, slug or goals.slug(seed)
    names = names or B.resolve([])
    with lock.held(engine.folder, slug):
        if engine.cache_path:
            cache.compacted(engine.spark, engine.cache_path)
        queries = queries if queries is not None else queries_for(engine, seed, n)
        log = (harvest_live if streamed else harvest)(engine, queries, slug, goal, names, per_backend, distil)
        return consolidate(engine, log, slug, goal, names, queries, synth, deep, discover)

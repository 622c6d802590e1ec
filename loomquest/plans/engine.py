"""The waves that campaigns are made of: search, and reading pages. Each is one Spark job per fetch, written before it is used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.functions import text as X
from loomquest.functions.html import page_parts
from loomquest.models.clients import Offline
from loomquest.sources import backends as B
from loomquest.sources import cache, transport
from loomquest.sources.tables import saved

MIN_TEXT, PAGE_CHARS = 200, 12_000
_REQUEST = "ord long, query string, q string, backend_ord int, backend string, try_ord int, url string, method string, form string, headers map<string,string>"


@dataclass
class Engine:
    """A session with a way to fetch, a model client, and the state of hosts in this run."""

    spark: SparkSession
    folder: str
    transport: object = field(default_factory=transport.Http)
    client: object = field(default_factory=Offline)
    model: str | None = None
    settings: dict = field(default_factory=B.settings)
    cache_path: str | None = None
    states: dict = field(default_factory=dict)
    #: Hosts asked at a time, at most (the session's shuffle partitions where it is unset), and who is told how far it is.
    workers: int | None = None
    say: Callable[[str], None] = lambda text: None

    def _fetch(self, requests: DataFrame) -> DataFrame:
        """One wave: fetched once, written, and its host counters taken over."""
        rows = saved(transport.fetched(requests, self.transport, B.POLICIES, self.states, tasks=self.workers), "wave")
        self.states |= transport.host_states(rows)
        return rows

    def search(self, queries: DataFrame, names: list[str], per_backend: int = 6, anchor: str | None = None) -> DataFrame:
        """queries: ord, query. Hits of every query from the named backends: ord, query, hit_ord, title, url, snippet, source.

        Queries meet backends in a flat map; cached answers are not asked again; the rest goes to its hosts; a backend's second address is asked only
        where the first gave nothing."""
        n = per_backend
        asked = queries.withColumn("q", X.build_query(F.col("query"), F.lit(anchor) if anchor else None))
        requests = saved(fanned(asked, names, n, self.settings).withColumn("key", cache.key(F.col("backend"), F.col("q"), F.lit(n))), "requests")
        wanted = requests.select("ord", "query", "backend_ord", "backend", "key").distinct()
        kept = saved(cache.read(self.spark, self.cache_path, keys=requests), "cached") if self.cache_path else self.spark.createDataFrame([], "key string, body string")
        answers, rest = kept, cache.misses(requests, kept)
        for attempt in range(2):
            wave = rest.where(F.col("try_ord") == attempt)
            if attempt and wave.isEmpty():
                break
            got = self._fetch(wave.dropDuplicates(["key"])).where("body is not null").select("key", "body")
            # an answer without hits is no answer: it is not kept, and the next address is asked
            full = B.parsed(wanted.join(got, "key"), n).select("ord", "backend_ord").distinct().join(wanted, ["ord", "backend_ord"]).select("key").distinct()
            got = saved(got.join(full, "key", "left_semi").dropDuplicates(["key"]), "answers")
            if self.cache_path:
                cache.store(got, self.cache_path)
            answers, rest = answers.unionByName(got), cache.misses(rest, got)
        rows = saved(B.parsed(wanted.join(answers, "key"), n), "rows")
        if "wiki" in names:
            rows = self._summaries(rows)
        return saved(B.gathered(rows), "hits")

    def _summaries(self, rows: DataFrame) -> DataFrame:
        """Encyclopedia hits get the page's summary as snippet, where there is one: a second wave, by page."""
        wiki = F.col("backend") == "wiki"
        api = F.concat(F.lit("https://en.wikipedia.org/api/rest_v1/page/summary/"), F.regexp_extract("url", "/wiki/(.*)$", 1))
        pages = rows.where(wiki).select(F.col("url").alias("key"), api.alias("url")).distinct()
        asks = pages.select("key", F.lit(0).cast("long").alias("ord"), "url", F.lit("GET").alias("method"), F.lit("").alias("form"), F.lit(None).cast("map<string,string>").alias("headers"))
        got = self._fetch(asks).select(F.col("key").alias("url"), F.from_json("body", "extract string")["extract"].alias("__extract"))
        return with_summaries(rows, got)

    def read(self, sources: DataFrame, k: int, items: bool = False, links: bool = False, start: int = 0) -> DataFrame:
        """sources: rank, url, title. The first k with an http address, read: ord (start, start + 1, ...), url, title, text, items, links.

        Pages with at most 200 characters of text and no items are left out."""
        picked = sources.where(F.startswith("url", F.lit("http"))).orderBy("rank").limit(k)
        picked = saved(picked.select((F.row_number().over(W.orderBy("rank")) - 1 + start).cast("long").alias("ord"), "url", F.coalesce("title", F.lit("")).alias("title")), "picked")
        asks = picked.select(F.col("ord").cast("string").alias("key"), "ord", "url", F.lit("GET").alias("method"), F.lit("").alias("form"), F.lit(None).cast("map<string,string>").alias("headers"))
        got = self._fetch(asks).where("body is not null").select(F.col("key").cast("long").alias("ord"), "body")
        return saved(pages(picked.join(got, "ord").withColumnRenamed("body", "html"), items, links), "pages")

    def safety(self) -> dict:
        return transport.safety(self.states)


def with_summaries(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows of hits with the texts of told (url, __extract) as the snippets of encyclopedia hits, where there are any."""
    extract = F.when(F.col("backend") == "wiki", F.nullif("__extract", F.lit("")))
    return rows.join(told, "url", "left").withColumn("snippet", F.coalesce(extract, "snippet")).drop("__extract")


def fanned(asked: DataFrame, names: list[str], n: int, settings: dict) -> DataFrame:
    """asked: ord, query, q (what is sent). Every query with every backend and each of its addresses, as requests."""
    columns = ["ord", "query", "q", "backend_ord", "backend", "try_ord", "url", "method", "form", "headers"]

    def run(frames):
        for f in frames:
            rows = [
                (r.ord, r.query, r.q, i, name, k, x.url, x.method, x.form, dict(x.headers))
                for r in f.itertuples()
                for i, name in enumerate(names)
                for k, x in enumerate(B.BACKENDS[name].requests(r.q, n, settings))
            ]
            yield pd.DataFrame(rows, columns=columns)

    return asked.select("ord", "query", "q").mapInPandas(run, _REQUEST)


def pages(raw: DataFrame, items: bool = True, links: bool = True) -> DataFrame:
    """raw: ord, url, title, html. Adds text, items and links, drops pages that hold next to nothing."""
    d = raw.select("ord", "url", "title", page_parts(F.col("html"), F.col("url"), PAGE_CHARS, items, links).alias("__parts"))
    d = d.select("ord", "url", "title", "__parts.*")
    return d.where((F.length("text") > MIN_TEXT) | (F.size("items") > 0)).select("ord", "url", "title", "text", "items", "links")


def link_rows(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("ord").alias("doc_ord"), F.posexplode("links").alias("pos", "l"))
    return d.select("doc_ord", "pos", "l.url", "l.anchor")

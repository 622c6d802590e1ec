"""The twelve search backends: where each asks, and how its answer becomes hits, parsed in Catalyst.

A backend is data: its host, its URL, its schema or parser. An answer column of any size is parsed by from_json, from_xml or regular
expressions; malformed answers give no hits."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.functions import text as X
from loomquest.functions.html import unescape
from loomquest.streaming.breaker import Policy

# Seconds between requests, requests a run, and whether one block is enough to stop, by host.
POLICIES = {
    "html.duckduckgo.com": Policy(3.0, ban_prone=True),
    "lite.duckduckgo.com": Policy(3.0, ban_prone=True),
    "en.wikipedia.org": Policy(1.0),
    "hn.algolia.com": Policy(0.5),
    "lobste.rs": Policy(2.5, ban_prone=True),
    "api2.marginalia-search.com": Policy(2.0, 120, True),
    "api.crossref.org": Policy(1.0),
    "export.arxiv.org": Policy(3.0, 120, True),
    "api.semanticscholar.org": Policy(3.0, ban_prone=True),
    "api.stackexchange.com": Policy(2.0, 100, True),
    "api.github.com": Policy(6.0, 30, True),
    "api.openalex.org": Policy(1.0),
    "api.mojeek.com": Policy(1.0),
}
# Groups of backends, those used by default, and the setting that switches a backend on.
GROUPS = {
    "web": ["ddg", "marginalia", "mojeek", "wiki", "searxng"],
    "academic": ["crossref", "openalex", "semanticscholar", "arxiv", "wiki"],
    "tech": ["hn", "stackexchange", "github"],
}
DEFAULTS = ["ddg", "wiki", "hn"]
GATES = {"mojeek": "LOOM_MOJEEK_KEY", "searxng": "LOOM_SEARXNG_URL"}


@dataclass(frozen=True)
class Request:
    url: str
    method: str = "GET"
    form: str = ""
    headers: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Backend:
    """requests(query, n, settings): what to ask, alternatives in order. parse(answers): body to array of hits."""

    name: str
    requests: Callable[[str, int, dict], list[Request]]
    parse: Callable[[Column], Column]
    #: What an answer with hits holds, one of these; an answer without is followed by the next address.
    marks: tuple[str, ...] = ("",)

    def full(self, body: str | None) -> bool:
        return bool(body) and any(m in body for m in self.marks)


def _hit(title, url, snippet, source) -> Column:
    return F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(snippet, F.lit("")).alias("snippet"), (F.lit(source) if isinstance(source, str) else source).alias("source"))


def _or(*values) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _json(schema: str, path: str, row: Callable[[Column], Column]):
    """A parser of JSON answers: the array at path, each element to a hit, those without URL dropped."""

    def parse(body: Column) -> Column:
        found = F.from_json(body, schema)
        for part in path.split("."):
            found = found[part]
        return F.filter(F.transform(F.filter(found, lambda x: x.isNotNull()), row), lambda h: h["url"] != "")

    return parse


def _mojeek(body: Column) -> Column:
    item = "struct<url:string,link:string,title:string,desc:string,description:string>"
    d = F.from_json(body, f"response struct<results:array<{item}>>, results array<{item}>")
    rows = F.when(F.size(d["response"]["results"]) > 0, d["response"]["results"]).otherwise(d["results"])
    url = lambda r: _or(r["url"], r["link"])
    return F.filter(F.transform(rows, lambda r: _hit(X.strip_tags(_or(r["title"], url(r))), url(r), X.strip_tags(_or(r["desc"], r["description"])), "mojeek")), lambda h: h["url"] != "")


def _wiki(body: Column) -> Column:
    page = lambda r: F.concat(F.lit("https://en.wikipedia.org/wiki/"), X.quoted(F.replace(r["title"], F.lit(" "), F.lit("_"))))
    return _json("query struct<search:array<struct<title:string,snippet:string>>>", "query.search", lambda r: _hit(F.concat(F.lit("Wikipedia: "), r["title"]), page(r), X.strip_tags(r["snippet"]), "wiki"))(body)


def _crossref(body: Column) -> Column:
    item = "struct<title:array<string>,URL:string,DOI:string,abstract:string,`container-title`:array<string>>"

    def row(r):
        url = _or(r["URL"], F.concat(F.lit("https://doi.org/"), F.nullif(r["DOI"], F.lit(""))))
        return _hit(_or(F.get(r["title"], 0), url), url, _or(X.strip_tags(r["abstract"]), F.get(r["container-title"], 0)), "crossref")

    return _json(f"message struct<items:array<{item}>>", "message.items", row)(body)


def _arxiv(body: Column) -> Column:
    feed = F.from_xml(body, "entry array<struct<title:string,id:string,summary:string>>")
    row = lambda e: _hit(X.trim(e["title"]), X.trim(e["id"]), F.left(X.squeeze(X.trim(e["summary"])), F.lit(400)), "arxiv")
    return F.filter(F.transform(feed["entry"], row), lambda h: h["url"] != "")


def _ddg(body: Column) -> Column:
    """Result anchors and snippets are paired by place; the plain page's anchors serve where there are none."""
    all_ = lambda p, g: F.regexp_extract_all(body, F.lit(p), F.lit(g))
    full = r"""(?s)<a[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>"""
    lite = r"""(?s)<a[^>]+href="(https?://[^"]+)"[^>]*class="result-link"[^>]*>(.*?)</a>"""
    snippets = all_(r"""(?s)class="result__snippet"[^>]*>(.*?)</a>""", 1)
    pairs = F.arrays_zip(all_(full, 1).alias("h"), all_(full, 2).alias("t"))
    first = F.transform(pairs, lambda p, i: _hit(X.strip_tags(p["t"]), unwrapped(p["h"]), X.strip_tags(F.coalesce(F.get(snippets, i), F.lit(""))), "ddg"))
    first = F.filter(first, lambda h: h["url"] != "")
    plain = F.transform(F.arrays_zip(all_(lite, 1).alias("h"), all_(lite, 2).alias("t")), lambda p: _hit(X.strip_tags(p["t"]), unwrapped(p["h"]), F.lit(""), "ddg"))
    plain = F.filter(plain, lambda h: (h["url"] != "") & ~F.contains(h["url"], F.lit("duckduckgo.com")))
    return F.when(F.size(first) > 0, first).otherwise(plain)


def unwrapped(href: Column) -> Column:
    """The address behind a redirecting link; '' for links that are not absolute. '+' is kept as it is."""
    full = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    inner = F.regexp_extract(full, "[?&]uddg=([^&]+)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), inner)
    return F.when(inner != "", decoded).when(F.startswith(full, F.lit("http")), full).otherwise("")


def _get(url: str, *headers):
    return lambda q, n, s: [Request(url.format(q=quote(q), n=n, contact=quote(s.get("contact", "anonymous@example.com")), **{k: quote(s.get(k, "")) for k in ("mojeek_key",)}), headers=headers)]


def _openalex_url(q: str, n: int, s: dict) -> list[Request]:
    key = f"&api_key={quote(s['openalex_key'])}" if s.get("openalex_key") else ""
    return [Request(f"https://api.openalex.org/works?per_page={n}&mailto={quote(s.get('contact', 'anonymous@example.com'))}{key}&search={quote(q)}")]


def _ddg_requests(q: str, n: int, s: dict) -> list[Request]:
    form = urlencode({"q": q, "kl": "us-en"})
    return [Request(u, "POST", form) for u in ("https://html.duckduckgo.com/html/", "https://lite.duckduckgo.com/lite/")]


def _number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("string")


BACKENDS = {
    b.name: b
    for b in (
        Backend("ddg", _ddg_requests, _ddg, ("result__a", "result-link")),
        Backend(
            "marginalia",
            _get("https://api2.marginalia-search.com/search?query={q}", ("API-Key", "public")),
            _json("results array<struct<url:string,title:string,description:string>>", "results", lambda r: _hit(_or(r["title"], r["url"]), r["url"], X.strip_tags(r["description"]), "marginalia")),
        ),
        Backend("mojeek", _get("https://api.mojeek.com/search?fmt=json&api_key={mojeek_key}&q={q}"), _mojeek),
        Backend("wiki", _get("https://en.wikipedia.org/w/api.php?action=query&list=search&format=json&srlimit={n}&srsearch={q}"), _wiki),
        Backend("crossref", _get("https://api.crossref.org/works?rows={n}&select=title,URL,DOI,container-title,abstract&mailto={contact}&query={q}"), _crossref),
        Backend("arxiv", _get("https://export.arxiv.org/api/query?sortBy=relevance&max_results={n}&search_query=all:{q}"), _arxiv),
        Backend(
            "semanticscholar",
            _get("https://api.semanticscholar.org/graph/v1/paper/search?limit={n}&fields=title,url,abstract,year&query={q}"),
            _json(
                "data array<struct<url:string,title:string,abstract:string,year:int>>",
                "data",
                lambda r: _hit(F.concat(_or(r["title"], r["url"]), F.when(r["year"] > 0, F.concat(F.lit(" ("), r["year"].cast("string"), F.lit(")"))).otherwise("")), r["url"], F.left(X.strip_tags(r["abstract"]), F.lit(400)), "s2"),
            ),
        ),
        Backend(
            "openalex",
            _openalex_url,
            _json(
                "results array<struct<doi:string,id:string,display_name:string,primary_location:struct<source:struct<display_name:string>>>>",
                "results",
                lambda r: _hit(_or(r["display_name"], r["doi"], r["id"]), _or(r["doi"], r["id"]), r["primary_location"]["source"]["display_name"], "openalex"),
            ),
        ),
        Backend(
            "hn",
            _get("https://hn.algolia.com/api/v1/search?tags=story&hitsPerPage={n}&query={q}"),
            _json(
                "hits array<struct<url:string,objectID:string,title:string,story_text:string,points:int,num_comments:int>>",
                "hits",
                lambda r: _hit(
                    _or(r["title"], F.lit("(HN)")),
                    _or(r["url"], F.concat(F.lit("https://news.ycombinator.com/item?id="), r["objectID"])),
                    _or(F.left(r["story_text"], F.lit(400)), F.concat(F.lit("HN: "), _number(r["points"]), F.lit(" points, "), _number(r["num_comments"]), F.lit(" comments"))),
                    "hn",
                ),
            ),
        ),
        Backend(
            "stackexchange",
            _get("https://api.stackexchange.com/2.3/search/advanced?order=desc&sort=relevance&site=stackoverflow&pagesize={n}&q={q}"),
            _json(
                "items array<struct<link:string,title:string,tags:array<string>,score:int,answer_count:int>>",
                "items",
                lambda r: _hit(
                    X.strip_tags(_or(r["title"], r["link"])),
                    r["link"],
                    F.concat(F.lit("score "), _number(r["score"]), F.lit(", "), _number(r["answer_count"]), F.lit(" answers"), F.when(F.size(r["tags"]) > 0, F.concat(F.lit(" ["), F.array_join(F.slice(r["tags"], 1, 5), ", "), F.lit("]"))).otherwise("")),
                    "stack",
                ),
            ),
        ),
        Backend(
            "github",
            _get("https://api.github.com/search/repositories?per_page={n}&q={q}", ("Accept", "application/vnd.github+json")),
            _json(
                "items array<struct<full_name:string,html_url:string,description:string,stargazers_count:int>>",
                "items",
                lambda r: _hit(_or(r["full_name"], F.lit("(repo)")), r["html_url"], F.left(F.concat(X.strip_tags(r["description"]), F.lit("  ★"), _number(r["stargazers_count"])), F.lit(300)), "github"),
            ),
        ),
        Backend(
            "searxng",
            lambda q, n, s: [Request(f"{s['searxng_url'].rstrip('/')}/search?format=json&q={quote(q)}")],
            _json(
                "results array<struct<url:string,title:string,content:string,engine:string>>",
                "results",
                lambda r: _hit(X.strip_tags(_or(r["title"], r["url"])), r["url"], F.left(X.strip_tags(r["content"]), F.lit(400)), F.concat(F.lit("searx:"), F.coalesce(r["engine"], F.lit("")))),
            ),
        ),
    )
}


def settings() -> dict:
    """What the environment says; read on the driver once and sent along."""
    env = lambda k: os.environ.get(k, "").strip()
    found = {"contact": env("LOOM_CONTACT"), "mojeek_key": env("LOOM_MOJEEK_KEY"), "openalex_key": env("LOOM_OPENALEX_KEY"), "searxng_url": env("LOOM_SEARXNG_URL")}
    return {k: v for k, v in found.items() if v}


def available(name: str) -> bool:
    return name in BACKENDS and (name not in GATES or bool(os.environ.get(GATES[name], "").strip()))


def resolve(spec: list[str]) -> list[str]:
    """Backends that a list of names and groups stands for, each once, in order; the defaults where none is left."""
    groups = GROUPS | {"all": list(BACKENDS)}
    named = dict.fromkeys(b for token in spec for b in groups.get(token, [token]))
    return [b for b in named if available(b)] or [b for b in DEFAULTS if available(b)]


def parsed(answers: DataFrame, n: int) -> DataFrame:
    """answers: ord, query, backend_ord, backend, body (null: no answer). Rows: those columns without body, hit_ord, title, url, snippet, source, at most n an answer."""
    bodies = F.col("body")
    by = None
    for b in BACKENDS.values():
        by = (by.when if by is not None else F.when)(F.col("backend") == b.name, b.parse(bodies))
    rows = answers.withColumn("__hits", F.slice(by, 1, n)).select("ord", "query", "backend_ord", "backend", F.posexplode("__hits").alias("hit_ord", "h"))
    # Entities are resolved once, after the parse, in Arrow batches.
    return rows.select("ord", "query", "backend_ord", "backend", "hit_ord", unescape(F.col("h.title")).alias("title"), F.col("h.url").alias("url"), unescape(F.col("h.snippet")).alias("snippet"), F.col("h.source").alias("source"))


def gathered(rows: DataFrame) -> DataFrame:
    """Per query each URL once, the first in order of backends, and then in that of its hits; hit_ord counts anew."""
    order = W.partitionBy("ord", "url").orderBy("backend_ord", "hit_ord")
    kept = rows.where(F.col("url") != "").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    place = F.row_number().over(W.partitionBy("ord").orderBy("backend_ord", "hit_ord")) - 1
    return kept.withColumn("hit_ord", place).select("ord", "query", "hit_ord", "title", "url", "snippet", "source")

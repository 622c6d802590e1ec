"""The queries over the driver's tables, by name, with the SQL that states each.

Documents stand in for hits and facts, pages for fetched pages, events for a fetch log, conversations for rounds, benchmark texts for queries and goals."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.functions import goals
from loomquest.functions import patterns as P
from loomquest.functions import text as X
from loomquest.functions.html import all_page_links, page_items
from loomquest.models.tasks import chunk_number
from loomquest.operators import items, many, rank, records
from loomquest.plans.engine import fanned
from loomquest.plans import report
from loomquest.sources import backends, cache, corpora, sink
from loomquest.sources.tables import scratch
from loomquest.streaming import breaker

GOAL = "list of overused words: thentio, ening, edness and ution in the text"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL of the text functions -----------------------------------------------------------------------------------------------------------

_Q = "\"''“”’"  # quotes, as an SQL literal holds them
_WS = r"[ \t\r\n\f\v]+"
_WSC = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _trim(x: str) -> str:
    return f"trim({x}, {_WSC})"


def _list_item(x: str) -> str:
    return f"rtrim(trim({_trim(f'ltrim({_trim(x)}, ' + chr(39) + '-*0123456789.)• ' + chr(39) + ' || chr(9))')}, '{_Q}'), ',;:')"


def _mention_key(x: str) -> str:
    base = f"rtrim(trim({_trim(f'regexp_replace({x}, {chr(39)}\\([^)]*\\){chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, '{_Q}'), ',;:.')"
    return f"lower({_trim(f'regexp_replace({base}, {chr(39)}(?i)^(the|a|an){_WS}{chr(39)}, {chr(39)}{chr(39)})')})"


def _has(x: str, p: str) -> str:
    return f"regexp_matches({x}, '{_sql(p)}')"


def _query_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _overlap(x: str, goal: str = GOAL) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), '{t}') AS INT)" for t in goals.tokens(goal)) + ")"


def _bonus(x: str, strong: float, weak: float) -> str:
    return f"CASE WHEN {_has(x, P.LIST_TITLE)} THEN {strong} WHEN {_has(x, P.LIST_HINT)} THEN {weak} ELSE 0.0 END"


_STOP = "[" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "]"
_LINES = "(SELECT doc_id, source, CAST(i - 1 AS INT) AS pos, string_split(text, chr(10))[i] AS fact FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_ITEMS = f"(SELECT *, {_list_item('fact')} AS item FROM {_LINES})"
_CLEAN = f"(SELECT *, lower(item) AS key FROM {_ITEMS} WHERE length(item) BETWEEN 1 AND 120 AND NOT {_has('item', P.JUNK)})"
_HITS = """(SELECT d.doc_id AS rec_ord, 0 AS hit_ord, coalesce(CAST(l.quality AS DOUBLE), 0.0) AS relevance, left(d.text, 60) AS title,
  'doc://' || d.source || '/' || (d.doc_id // 3) AS url, substr(d.text, 61) AS snippet, d.source FROM documents d LEFT JOIN labels l USING (doc_id))"""


# --- the tables as hits and facts --------------------------------------------------------------------------------------------------------


def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.as_facts(table(spark, sf_dir, "documents"))


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.as_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: users are hosts, errors are soft blocks."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("host"), F.col("ts"), F.when(F.col("event_type") == "error", "soft").otherwise("ok").alias("signal"))


_LOG = "(SELECT event_id, CAST(user_id AS VARCHAR) AS host, ts, CASE WHEN event_type = 'error' THEN 'soft' ELSE 'ok' END AS signal FROM events)"


# --- lists and mentions ------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH g AS (SELECT key, arg_min(item, (doc_id, pos)) AS item, count(DISTINCT source) AS n_sources FROM {_CLEAN} GROUP BY key),
n AS (SELECT count(*) FILTER (n_sources >= 2) AS n_corroborated FROM g),
k AS (SELECT g.*, n_corroborated, row_number() OVER (ORDER BY n_sources DESC, lower(item), key) AS rank FROM g, n WHERE n_sources >= 2 OR n_corroborated < 25)
SELECT CAST(rank AS INT) AS rank, item, n_sources, n_corroborated FROM k WHERE rank <= 400""")
def corroborated_items(spark, sf_dir):
    """A list goal over the lines of documents: items on two or more sources first."""
    return items.compiled_list(facts_of(spark, sf_dir), ["doc_id", "pos"]).drop("confidence")


@query(f"""
WITH g AS (SELECT key, count(DISTINCT source) AS n FROM {_CLEAN} GROUP BY key), c AS (SELECT count(*) FILTER (n >= 2) AS m, count(*) AS a FROM g)
SELECT m AS n_corroborated, CASE WHEN kept > 0 THEN least(0.95::DOUBLE, 0.35::DOUBLE + 0.6::DOUBLE * (m / greatest(1, kept))) ELSE 0.0::DOUBLE END AS confidence
FROM (SELECT m, least(400, CASE WHEN m < 25 THEN a ELSE m END) AS kept FROM c)""")
def enumerate_confidence(spark, sf_dir):
    return items.compiled_list(facts_of(spark, sf_dir), ["doc_id", "pos"]).select("n_corroborated", "confidence").limit(1)


@query(f"SELECT doc_id, pos, item, key FROM {_CLEAN}")
def list_items(spark, sf_dir):
    """Every line that counts as an item of a list."""
    return items.listable(facts_of(spark, sf_dir)).select("doc_id", "pos", "item", "key")


MENTIONS = f"""(SELECT *, {_mention_key('item')} AS key FROM (SELECT doc_id, pos, source, {_trim('fact')} AS item FROM {_LINES})
  WHERE length(item) >= 2 AND {_has('item', '[A-Za-z]')} AND NOT {_has('item', P.JUNK)} AND NOT {_has('item', P.META)})"""


@query(f"""
WITH m AS (SELECT * FROM {MENTIONS} WHERE length(key) BETWEEN 2 AND 60)
SELECT arg_min(item, (doc_id, pos)) AS item, key, count(DISTINCT doc_id) AS sources, bool_or(source = 'src1') AS vetted FROM m GROUP BY key""")
def mention_census(spark, sf_dir):
    """Mentions by key, kept all: sources that mention each, and whether one that vets does."""
    d = facts_of(spark, sf_dir)
    found = items.mentions(d.select(F.col("fact").alias("item"), F.col("doc_id").cast("string").alias("url"), (F.col("query") == "src1").alias("vetted"), F.struct("doc_id", "pos").alias("ord")))
    return items.census_list(found).select("item", "key", "sources", "vetted")


@query(f"""
WITH m AS (SELECT * FROM {MENTIONS} WHERE length(key) BETWEEN 2 AND 60),
c AS (SELECT arg_min(item, (doc_id, pos)) AS item, count(DISTINCT doc_id) AS sources, bool_or(source = 'src1') AS vetted, min((doc_id, pos)) AS first FROM m GROUP BY key)
SELECT CAST(row_number() OVER (ORDER BY vetted DESC, sources DESC, first) AS INT) AS rank, item || '  (' || sources || ')' || CASE WHEN vetted THEN '' ELSE ' ~' END AS shown
FROM c QUALIFY rank <= 100""")
def census_top(spark, sf_dir):
    """The first hundred of the census, as a report shows them."""
    d = facts_of(spark, sf_dir)
    found = items.mentions(d.select(F.col("fact").alias("item"), F.col("doc_id").cast("string").alias("url"), (F.col("query") == "src1").alias("vetted"), F.struct("doc_id", "pos").alias("ord")))
    top = items.census_list(found).orderBy(*items.census_order()).limit(100)
    return top.select(F.row_number().over(W.orderBy(*items.census_order())).alias("rank"), items.shown(F.col("item"), F.col("sources"), F.col("vetted")).alias("shown"))


@query(f"""
WITH m AS (SELECT * FROM {MENTIONS} WHERE length(key) BETWEEN 2 AND 60), n AS (SELECT count(DISTINCT key) AS n_items, count(DISTINCT CASE WHEN source = 'src1' THEN key END) AS n_vetted FROM m)
SELECT n_items, n_vetted, least(0.95::DOUBLE, 0.4::DOUBLE + n_items / 2000.0::DOUBLE) AS confidence FROM n""")
def census_counters(spark, sf_dir):
    c = mention_census(spark, sf_dir).agg(F.count("*").alias("n_items"), F.count_if("vetted").alias("n_vetted"))
    return c.withColumn("confidence", records.census_confidence(F.col("n_items")))


@query(f"""
WITH w AS (SELECT turn AS round, {_query_key('text')} AS key FROM conversations), f AS (SELECT key, min(round) AS round FROM w GROUP BY key),
n AS (SELECT round, count(*) AS new_items FROM f GROUP BY round), r AS (SELECT DISTINCT round FROM w)
SELECT r.round, CAST(coalesce(new_items, 0) AS BIGINT) AS new_items, CAST(sum(coalesce(new_items, 0)) OVER (ORDER BY r.round) AS BIGINT) AS total_items FROM r LEFT JOIN n USING (round)""")
def saturation_curve(spark, sf_dir):
    """New keys a round and in all, turns as rounds."""
    return items.saturation(table(spark, sf_dir, "conversations").select(F.col("turn").alias("round"), X.query_key(F.col("text")).alias("key")))


@query(f"""
WITH w AS (SELECT turn + 1 AS round, {_query_key('text')} AS key, conv_id FROM conversations),
s AS (SELECT key, count(DISTINCT conv_id) AS sources, min(round) AS first_round, max(round) > 1 AS grew FROM w GROUP BY key)
SELECT key, sources, CAST(first_round AS BIGINT) AS first_round, grew FROM s""")
def state_merge(spark, sf_dir):
    """The first round's state merged with what later rounds found, key by key."""
    w = table(spark, sf_dir, "conversations").select(X.query_key(F.col("text")).alias("key"), F.col("text").alias("item"), F.col("conv_id").cast("string").alias("url"), (F.col("turn") + 1 > 1).alias("vetted"), (F.col("turn") + 1).alias("ord"))
    first, later = w.where("ord = 1").withColumn("new", F.lit(True)), w.where("ord > 1")
    now = items.merged(items.tally(first), items.tally(items.marked(later, first)))
    return now.select("key", "sources", F.col("first").cast("long").alias("first_round"), F.col("vetted").alias("grew"))


# --- ranking and dedupe ------------------------------------------------------------------------------------------------------------------

_RANKED = f"""WITH s AS (SELECT *, {_overlap("title || ' ' || snippet || ' ' || url")} AS overlap FROM {_HITS}),
c AS (SELECT *, overlap * 2.0::DOUBLE + relevance + {_bonus('title', 4.0, 1.5)} AS score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, rec_ord) AS rn, min(rec_ord) OVER (PARTITION BY url) AS first FROM c),
o AS (SELECT *, max(CAST(overlap > 0 AS INT)) OVER () AS topical FROM b WHERE rn = 1)"""


@query(f"{_RANKED} SELECT CAST(row_number() OVER (ORDER BY score DESC, first) AS INT) AS rank, url, title, snippet, source, CAST(score AS DOUBLE) AS score, overlap FROM o WHERE CAST(overlap > 0 AS INT) = topical QUALIFY rank <= 8")
def rank_sources_topk(spark, sf_dir):
    """The best sources for a list goal."""
    return rank.rank_sources(hits_of(spark, sf_dir), GOAL, rank.TOP_K, True)


#: Every benchmark text as a goal, against all hits.
SOURCES_OF_GOALS = f"""
WITH g AS (SELECT item_id, {_has('text', P.ENUMERABLE)} AS listing, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), lambda t: NOT list_contains({_STOP}, t))) AS tokens FROM benchmark),
h AS (SELECT *, lower(title || ' ' || snippet || ' ' || url) AS hay, {_bonus('title', 4.0, 1.5)} AS bonus FROM {_HITS}),
p AS (SELECT item_id, rec_ord, url, title, snippet, source, listing, relevance, bonus, CAST(len(list_filter(tokens, lambda t: contains(hay, t))) AS INT) AS overlap FROM g, h),
c AS (SELECT *, overlap * 2.0::DOUBLE + relevance + CASE WHEN listing THEN bonus ELSE 0.0::DOUBLE END AS score FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id, url ORDER BY score DESC, rec_ord) AS rn, min(rec_ord) OVER (PARTITION BY item_id, url) AS first FROM c),
o AS (SELECT *, max(CAST(overlap > 0 AS INT)) OVER (PARTITION BY item_id) AS topical FROM b WHERE rn = 1),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS INT) AS rank, url, title, snippet, source, CAST(score AS DOUBLE) AS score, overlap
  FROM o WHERE CAST(overlap > 0 AS INT) = topical QUALIFY rank <= 8)"""


@query(f"{SOURCES_OF_GOALS} SELECT item_id, rank, url, title, snippet, source, score, overlap FROM r")
def sources_of_goals(spark, sf_dir):
    """The best sources of every goal of a table at once."""
    goals_of = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("goal_id"), F.col("text").alias("goal"), F.col("text").rlike(P.ENUMERABLE).alias("listing"))
    return many.rank_for_goals(hits_of(spark, sf_dir), goals_of).withColumnRenamed("goal_id", "item_id")


@query(f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rec_ord) AS rn FROM {_HITS})
SELECT CAST(row_number() OVER (ORDER BY relevance DESC, rec_ord) AS INT) AS rank, url, title, source, relevance FROM f WHERE rn = 1 QUALIFY rank <= 10""")
def top_sources_by_relevance(spark, sf_dir):
    return rank.top_sources(hits_of(spark, sf_dir))


@query(f"SELECT rec_ord, title, url, snippet, source FROM {_HITS} QUALIFY row_number() OVER (PARTITION BY url ORDER BY rec_ord) = 1")
def first_seen_dedupe(spark, sf_dir):
    """Each address once, with its first hit."""
    return records.first_seen(hits_of(spark, sf_dir), "url", ["rec_ord", "hit_ord"]).select("rec_ord", "title", "url", "snippet", "source")


@query(f"""
WITH r AS (SELECT rec_ord // 50 AS ord, CAST(source[4:] AS INT) % 3 AS backend_ord, CAST(rec_ord AS INT) AS hit_ord, title, url, snippet, source FROM {_HITS}),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ord, url ORDER BY backend_ord, hit_ord) = 1)
SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY backend_ord, hit_ord) - 1 AS INT) AS hit_ord, title, url, snippet, source FROM k""")
def gather_union(spark, sf_dir):
    """Hits of one query from several backends: each address once, in order of backends."""
    b = F.col("source").substr(4, 10).cast("int") % 3
    rows = hits_of(spark, sf_dir).select(F.floor(F.col("rec_ord") / 50).alias("ord"), F.lit("q").alias("query"), b.alias("backend_ord"), F.col("rec_ord").cast("int").alias("hit_ord"), "title", "url", "snippet", "source")
    return backends.gathered(rows).drop("query")


# --- pages -------------------------------------------------------------------------------------------------------------------------------

_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_HREFS = f"""(SELECT page_id, i AS pos, split_part({_ORIGIN} || href[i], '#', 1) AS url, anchor[i] AS anchor FROM (
  SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1) AS href, regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2) AS anchor,
  unnest(range(1, len(href) + 1)) AS i FROM pages))"""


@query(f"SELECT page_id, url, arg_min(anchor, pos) AS anchor FROM {_HREFS} GROUP BY page_id, url")
def page_outlinks(spark, sf_dir):
    """Every page's distinct links, by the HTML parser."""
    d = table(spark, sf_dir, "pages").select("page_id", F.explode(all_page_links("html", "url")).alias("l"))
    return d.select("page_id", "l.url", "l.anchor")


LINK_GOAL = "examples of tion erblest heron and thand"


@query(f"""
WITH l AS (SELECT page_id, pos, url, anchor, {_overlap("anchor || ' ' || url", LINK_GOAL)} AS overlap FROM {_HREFS} WHERE NOT {_has('url', P.SHARE)} AND NOT {_has('url', P.BAD_FILE)}),
s AS (SELECT *, overlap * 2.0::DOUBLE + {_bonus('anchor', 3.0, 1.0)} AS score FROM l WHERE overlap > 0),
b AS (SELECT url, max(score) AS score, arg_max(anchor, (score, -page_id, -pos)) AS title, min((page_id, pos)) AS first FROM s GROUP BY url)
SELECT CAST(row_number() OVER (ORDER BY score DESC, first) AS INT) AS rank, url, title, CAST(score AS DOUBLE) AS score FROM b WHERE url NOT IN (SELECT split_part(url, '#', 1) FROM pages) QUALIFY rank <= 6""")
def discover_links(spark, sf_dir):
    """The best links that no page of the table is."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id").alias("doc_ord"), F.posexplode(all_page_links("html", "url")).alias("pos", "l")).select("doc_ord", "pos", "l.url", "l.anchor")
    seen = pages.select(F.split_part("url", F.lit("#"), F.lit(1)).alias("url"))
    return rank.discover_links(found, seen, LINK_GOAL, rank.DISCOVER_N, True)


def _page_text_sql() -> str:
    t = "html"
    for b in P.CLOSED_BLOCKS:
        t = f"regexp_replace({t}, '(?is)<{b}[^>]*>.*?</{b}>', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g')"
    return _trim(f"regexp_replace({t}, '\\n[ \\t\\r\\n\\f\\v]*\\n', chr(10), 'g')")


@query(f"SELECT page_id, {_page_text_sql()} AS text FROM pages")
def page_texts(spark, sf_dir):
    """The whole text of pages, entities as they are."""
    return table(spark, sf_dir, "pages").select("page_id", X.page_text(F.col("html"), None).alias("text"))


@query(f"SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL")
def pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, url, NOT {_has('url', P.SHARE)} AND NOT {_has('url', P.BAD_FILE)} AS follow FROM (SELECT page_id, unnest([url, url || '/a.pdf?x=1', url || '/feed/', 'https://wa.me/' || page_id]) AS url FROM pages)")
def followable_links(spark, sf_dir):
    d = table(spark, sf_dir, "pages")
    url = F.explode(F.array("url", F.concat("url", F.lit("/a.pdf?x=1")), F.concat("url", F.lit("/feed/")), F.concat(F.lit("https://wa.me/"), "page_id")))
    return d.select("page_id", url.alias("url")).withColumn("follow", X.followable(F.col("url")))


# --- queries and goals -------------------------------------------------------------------------------------------------------------------


@query(f"SELECT item_id, {_query_key('text')} AS key FROM benchmark")
def query_normalise(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.query_key(F.col("text")).alias("key"))


@query(f"""
WITH q AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'), '{_WS}', ' ', 'g'), ' -—.?!,') AS q FROM benchmark),
a AS (SELECT item_id, CASE WHEN ({_has('q', P.PRONOUN)} OR len(list_filter(string_split(q, ' '), lambda w: w <> '')) < 6) AND NOT contains(lower(q), 'thered') THEN 'thered ' || q ELSE q END AS q FROM q)
SELECT item_id, array_to_string(list_slice(list_filter(string_split(q, ' '), lambda w: w <> ''), 1, 18), ' ') AS q FROM a""")
def build_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.build_query(F.col("text"), F.lit("thered")).alias("q"))




@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), lambda t: NOT list_contains({_STOP}, t)))), ' ') AS tokens FROM benchmark")
def goal_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(X.goal_tokens(F.col("text"))), " ").alias("tokens"))


@query("SELECT item_id, coalesce(nullif(trim(left(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), 48), '-'), ''), 'search') AS slug FROM benchmark")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.slug(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, pos, {_has('fact', P.ENUMERABLE)} AS listing, {_has('fact', P.EXHAUSTIVE)} AS exhaustive, {_has('fact', P.LIST_HINT)} AS list_hint FROM {_LINES}")
def goal_shapes(spark, sf_dir):
    """What lines would ask for as goals."""
    f = F.col("fact")
    return facts_of(spark, sf_dir).select("doc_id", "pos", f.rlike(P.ENUMERABLE).alias("listing"), f.rlike(P.EXHAUSTIVE).alias("exhaustive"), f.rlike(P.LIST_HINT).alias("list_hint"))


_FACETS = "[" + ", ".join(f"'{f}'" for f in P.FACETS) + "]"


@query(f"""
WITH s AS (SELECT item_id, text AS seed FROM benchmark),
x AS (SELECT item_id, i AS pos, CASE WHEN i = 1 THEN {_trim('seed')} ELSE regexp_replace(trim({_trim("regexp_replace(seed || ' ' || " + _FACETS + "[i], '^[ \\t\\r\\n\\f\\v0-9.)*\"''-]+', '')")}, '"'''), '{_WS}', ' ', 'g') END AS q FROM s, (SELECT unnest(range(1, 17)) AS i)),
u AS (SELECT * FROM x WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY item_id, lower(q) ORDER BY pos) = 1)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) AS INT) AS place, q FROM u QUALIFY place <= 12""")
def facet_expansion(spark, sf_dir):
    """Every seed with its facets, distinct without regard to case, twelve at most."""
    wider = F.pandas_udf(lambda s: s.map(lambda seed: goals.facet_queries(seed, 12)), "array<string>")
    d = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(wider("text")).alias("pos", "q"))
    return d.select("item_id", (F.col("pos") + 1).alias("place"), "q")


_GOALS = """(SELECT item_id, unnest([0, 1, 2, 3]) AS form, unnest([t, 'list of every ' || t || ' on the internet', 'what is ' || t, 'Give me a complete list of ' || t || '.']) AS goal
  FROM (SELECT item_id, text AS t FROM benchmark))"""


@query(f"""
WITH c AS (SELECT *, {_trim(f"regexp_replace(regexp_replace(regexp_replace({_trim('goal')}, '{_sql(P.LEAD)}', ''), '{_sql(P.QUANTIFIER)}', ''), '{_sql(P.TRAIL)}', '')")} AS core FROM {_GOALS}),
e AS (SELECT *, coalesce(nullif(trim(core, ' .,-'), ''), {_trim('goal')}) AS entity FROM c),
s AS (SELECT *, {_has('goal', P.ENUMERABLE)} AND NOT {_has('goal', P.NOT_CENSUS)} AND len(list_filter(string_split(entity, ' '), lambda w: w <> '')) BETWEEN 1 AND 8 AND NOT contains(entity, '?') AS census FROM e)
SELECT item_id, form, entity, census, CASE WHEN census AND {_has('goal', P.EXHAUSTIVE)} THEN 'exhaustive' ELSE 'quick' END AS scope, CAST(greatest(1, round_even((item_id % 40) * 8 / 60.0, 0)) AS BIGINT) AS minutes FROM s""")
def goal_plans(spark, sf_dir):
    """What goals of four forms are of, whether a census suits them, at which scope, and how long a quick campaign of some queries takes."""
    plan = F.pandas_udf(lambda g: pd.DataFrame([(goals.entity(x), goals.suits_census(x), goals.scope(x)) for x in g], columns=["entity", "census", "scope"]), "entity string, census boolean, scope string")
    minutes = F.pandas_udf(lambda n: n.map(goals.minutes), "long")
    t = F.col("text")
    forms = F.array(t, F.concat(F.lit("list of every "), t, F.lit(" on the internet")), F.concat(F.lit("what is "), t), F.concat(F.lit("Give me a complete list of "), t, F.lit(".")))
    d = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(forms).alias("form", "goal")).withColumn("p", plan("goal"))
    return d.select("item_id", "form", "p.entity", "p.census", "p.scope", minutes(F.col("item_id") % 40).alias("minutes"))


@query("SELECT doc_id, replace(url_encode(text), '%2F', '/') AS path FROM documents")
def quoted_paths(spark, sf_dir):
    """Texts as parts of an address."""
    return table(spark, sf_dir, "documents").select("doc_id", X.quoted(F.col("text")).alias("path"))


@query(f"SELECT page_id, {_trim("regexp_replace(html, '<[^>]+>', '', 'g')")} AS text FROM pages")
def stripped_pages(spark, sf_dir):
    """Pages without tags, trimmed."""
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("""
WITH i AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS l FROM pages), x AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS pos, l FROM i),
t AS (SELECT page_id, pos, trim(regexp_replace(l[pos], '[ \t\r\n]+', ' ', 'g')) AS item FROM x)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS INT) AS place, item FROM t WHERE length(item) BETWEEN 1 AND 120 GROUP BY page_id, item""")
def page_list_items(spark, sf_dir):
    """Entries of the lists of pages, whose navigation is taken for content here."""
    open_ = F.replace(F.replace("html", F.lit("<nav>"), F.lit("<section>")), F.lit("</nav>"), F.lit("</section>"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(page_items(open_)).alias("place", "item"))


@query("SELECT item_id, left(sha1(concat_ws(':', 'hn', CAST(item_id % 7 AS VARCHAR), text)), 20) AS key FROM benchmark")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", cache.key(F.lit("hn"), F.col("text"), F.col("item_id") % 7).alias("key"))


# --- resume and fan-out ------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH q AS (SELECT item_id AS ord, text AS query FROM benchmark UNION ALL SELECT 100000 + item_id, text || ' !' FROM benchmark WHERE item_id % 2 = 0),
d AS (SELECT DISTINCT {_query_key('text')} AS key FROM benchmark WHERE item_id % 3 = 0), k AS (SELECT *, {_query_key('query')} AS key FROM q)
SELECT ord, query FROM k WHERE key NOT IN (SELECT key FROM d) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1""")
def fresh_queries(spark, sf_dir):
    """Queries of a round that no earlier one asked in any spelling."""
    b = table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("ord"), F.col("text").alias("query")).union(b.where("item_id % 2 = 0").select(F.col("item_id") + 100000, F.concat("text", F.lit(" !"))))
    return records.todo(q, b.where("item_id % 3 = 0").select(F.col("text").alias("query")), normalised=True)


@query("SELECT item_id AS ord, text AS query FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id % 3 = 0 AND item_id % 2 = 0)")
def resume_anti_join(spark, sf_dir):
    """Queries without a record, or with a failed one only."""
    b = table(spark, sf_dir, "benchmark")
    done = b.where("item_id % 3 = 0").select(F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 1, "timeout").alias("error"))
    return records.todo(b.select(F.col("item_id").alias("ord"), F.col("text").alias("query")), done)


@query("""
WITH g(token, backend, i) AS (VALUES ('web', 'ddg', 0), ('web', 'marginalia', 1), ('web', 'wiki', 3), ('tech', 'hn', 0), ('tech', 'stackexchange', 1), ('tech', 'github', 2)),
s(token, t) AS (VALUES ('web', 0), ('hn', 1), ('tech', 2)), m AS (SELECT coalesce(g.backend, s.token) AS backend, t, coalesce(i, 0) AS i FROM s LEFT JOIN g USING (token)),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY backend ORDER BY t, i) = 1)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY t, i) - 1 AS INT) AS backend_ord, backend FROM benchmark, u""")
def backend_fanout(spark, sf_dir):
    """Every query with every backend that a list of names and groups stands for."""
    names = [b for b in backends.resolve(["web", "hn", "tech", "nobody"]) if b not in backends.GATES]
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("query"), X.build_query(F.col("text")).alias("q"))
    return fanned(asked, names, 6, {}).where("try_ord = 0").select(F.col("ord").alias("item_id"), "backend_ord", "backend")


# --- answers of the backends ---


def _answers() -> list[tuple[str, str, tuple[str, str, str, str]]]:
    """Per backend the answer that a document stands for, as an SQL expression, and the hit in it as SQL: title, url, snippet, source. h is a
    whole number, s and l are words. Rows without an address in an answer are no hits."""
    j = lambda text: "concat(" + ", ".join(f"'{p}'" if i % 2 == 0 else f"CAST({p} AS STRING)" for i, p in enumerate(text.split("~"))) + ")"
    url = "concat('http://h/', h)"
    title = "concat('A ', s)"
    return [
        ("ddg", j('<a class="result__a" href="//duckduckgo.com/l/?uddg=http%3A%2F%2Fh%2F~h~&rut=1">A <b>~s~</b></a><a class="result__snippet" href="x"> ~l~ &amp; <i>x</i> </a><a class="result__a" href="javascript:x">no</a>'), (title, url, "concat(l, ' & x')", "'ddg'")),
        ("marginalia", j('{"results": [{"title": "no"}, {"url": "http://h/~h~", "title": "A ~s~", "description": "<b>~l~</b>"}]}'), (title, url, "l", "'marginalia'")),
        ("mojeek", j('{"response": {"results": [{"url": "http://h/~h~", "title": "A <b>~s~</b>", "desc": "~l~"}]}}'), (title, url, "l", "'mojeek'")),
        ("wiki", j('{"query": {"search": [{"title": "A ~s~", "snippet": "<span>~l~</span> x"}]}}'), ("concat('Wikipedia: A ', s)", "concat('https://en.wikipedia.org/wiki/A_', s)", "concat(l, ' x')", "'wiki'")),
        ("crossref", j('{"message": {"items": [{"DOI": "10/~h~", "title": ["A ~s~"], "container-title": ["~l~"]}, {"title": ["no"]}]}}'), (title, "concat('https://doi.org/10/', h)", "l", "'crossref'")),
        ("arxiv", j("<feed><entry><id> http://h/~h~ </id><title> A ~s~ </title><summary> ~l~   y</summary></entry></feed>"), (title, url, "concat(l, ' y')", "'arxiv'")),
        ("semanticscholar", j('{"data": [{"url": "http://h/~h~", "title": "A ~s~", "year": 1999, "abstract": "~l~"}, {"title": "no", "url": ""}]}'), ("concat('A ', s, ' (1999)')", url, "l", "'s2'")),
        ("openalex", j('{"results": [{"id": "http://h/~h~", "doi": null, "display_name": "A ~s~", "primary_location": {"source": {"display_name": "~l~"}}}]}'), (title, url, "l", "'openalex'")),
        ("hn", j('{"hits": [{"objectID": "~h~", "title": "A ~s~", "points": ~h~, "num_comments": null}]}'), (title, "concat('https://news.ycombinator.com/item?id=', h)", "concat('HN: ', h, ' points, 0 comments')", "'hn'")),
        ("stackexchange", j('{"items": [{"link": "http://h/~h~", "title": "A ~s~ &lt; b", "tags": ["~l~", "t"], "score": ~h~, "answer_count": 2}]}'), ("concat('A ', s, ' < b')", url, "concat('score ', h, ', 2 answers [', l, ', t]')", "'stack'")),
        ("github", j('{"items": [{"full_name": "A ~s~", "html_url": "http://h/~h~", "description": "~l~", "stargazers_count": ~h~}]}'), (title, url, "concat(l, '  ★', h)", "'github'")),
        ("searxng", j('{"results": [{"url": "http://h/~h~", "title": "A ~s~", "content": "~l~", "engine": "e"}, {"title": "no"}]}'), (title, url, "l", "'searx:e'")),
    ]


def _place_sql() -> str:
    made = _answers()
    case = lambda k: "CASE backend_ord " + " ".join(f"WHEN {i} THEN {hit[k]}" for i, (_, _, hit) in enumerate(made)) + " END"
    names = "[" + ", ".join(f"'{n}'" for n, _, _ in made) + "]"
    return f"""WITH d AS (SELECT doc_id, CAST(doc_id % {len(made)} AS INT) AS backend_ord, CAST(doc_id AS VARCHAR) AS h, source AS s, lang AS l FROM documents)
SELECT doc_id, {names}[backend_ord + 1] AS backend, {case(0)} AS title, {case(1)} AS url, {case(2)} AS snippet, {case(3)} AS source FROM d"""


@query(_place_sql())
def backend_answers(spark, sf_dir):
    """An answer of every backend by turns, one a document, parsed into hits."""
    made = _answers()
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(made)).cast("int").alias("backend_ord"), F.col("doc_id").cast("string").alias("h"), F.col("source").alias("s"), F.col("lang").alias("l"))
    body = F.expr("CASE backend_ord " + " ".join(f"WHEN {i} THEN {text}" for i, (_, text, _) in enumerate(made)) + " END")
    backend = F.get(F.array(*[F.lit(n) for n, _, _ in made]), F.col("backend_ord"))
    answers = d.select(F.col("doc_id").alias("ord"), F.lit("q").alias("query"), "backend_ord", backend.alias("backend"), body.alias("body"))
    return backends.parsed(answers, 6).select(F.col("ord").alias("doc_id"), "backend", "title", "url", "snippet", "source")


# --- hosts -------------------------------------------------------------------------------------------------------------------------------

_REPLAY = f"""(SELECT *, row_number() OVER w AS seq, CAST(coalesce(sum(CAST(signal <> 'ok' AS INT)) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blocks_before
  FROM {_LOG} WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))"""


@query(f"SELECT event_id, host, signal, seq, blocks_before, seq <= 30 AND blocks_before < 3 AS admitted FROM {_REPLAY}")
def breaker_replay(spark, sf_dir):
    """Which requests of a log a cap and a breaker would have let through."""
    return breaker.replay(log_of(spark, sf_dir), 30, ["ts", "event_id"]).select("event_id", "host", "signal", "seq", "blocks_before", "admitted")


@query(f"SELECT host, count(*) FILTER (seq <= 30 AND blocks_before < 3) AS requests, count(*) FILTER (signal <> 'ok' AND seq <= 30 AND blocks_before < 3) AS blocks, bool_or(NOT (seq <= 30 AND blocks_before < 3)) AS tripped FROM {_REPLAY} GROUP BY host")
def host_status(spark, sf_dir):
    r = breaker.replay(log_of(spark, sf_dir), 30, ["ts", "event_id"])
    return r.groupBy("host").agg(F.count_if("admitted").alias("requests"), F.count_if(F.col("admitted") & (F.col("signal") != "ok")).alias("blocks"), F.bool_or(~F.col("admitted")).alias("tripped"))


@query(f"""
SELECT event_id, host, CASE WHEN lag(ts) OVER w IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 3600.0::DOUBLE - (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000) END AS wait_s
FROM {_LOG} WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)""")
def host_gap_wait(spark, sf_dir):
    """How long each request would have waited for an hour's gap."""
    return breaker.waits(log_of(spark, sf_dir), 3600.0, ["ts", "event_id"]).select("event_id", "host", "wait_s")


@query("SELECT event_id, CASE WHEN code IS NULL THEN 'error' WHEN code IN (429, 503) AND user_id % 2 = 0 THEN 'soft' WHEN code = 202 OR code >= 400 THEN 'hard' ELSE 'ok' END AS signal FROM (SELECT *, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 202 WHEN 4 THEN 503 END AS code FROM events)")
def outcome_signals(spark, sf_dir):
    """Outcomes of requests as signals; hosts with even numbers are friendly."""
    code = F.get(F.array(*[F.lit(c) for c in (200, 429, 403, 202, 503)]), (F.col("event_id") % 6).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", code.alias("code"))
    failed = F.col("code").isNull() | (F.col("code") >= 400)  # as the transport says
    return e.select("event_id", breaker.signals(F.col("code"), failed, F.col("user_id") % 2 != 0).alias("signal"))


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS blocks FROM events GROUP BY ALL")
def events_windowed(spark, sf_dir):
    """Requests a day and kind: the batch form of the streaming rate."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("blocks"))
    return g.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "blocks")


# --- facts and counters ------------------------------------------------------------------------------------------------------------------


@query("""
SELECT text AS fact, source AS query, 0 AS src FROM (SELECT unnest(string_split(text, chr(10))) AS text, source FROM documents)
UNION ALL SELECT unnest(string_split(text, chr(10))), 'deep-read: conv://' || conv_id, 1 FROM conversations""")
def facts_union(spark, sf_dir):
    """Facts of digests and of pages, each with where it comes from."""
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("query"), F.struct(F.split("text", "\n").alias("facts")).alias("digest"))
    p = table(spark, sf_dir, "conversations").select(F.col("turn").alias("ord"), F.concat(F.lit("conv://"), "conv_id").alias("url"), F.split("text", "\n").alias("items"))
    return records.all_facts(r, p).select("fact", "query", "src")


@query(f"""
WITH f AS (SELECT unnest(string_split(text, chr(10))) AS fact, source AS query FROM documents UNION ALL SELECT unnest(string_split(text, chr(10))), 'deep-read: conv://' || conv_id FROM conversations)
SELECT fact, query FROM f WHERE query LIKE 'deep-read:%'""")
def page_facts_preferred(spark, sf_dir):
    return items.prefer_pages(facts_union(spark, sf_dir)).select("fact", "query")


@query(f"""
WITH m AS (SELECT coalesce(avg(CAST(quality AS DOUBLE)), 0) AS mean_relevance FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS facts FROM {_LINES})
SELECT mean_relevance, facts, least(0.9::DOUBLE, 0.20::DOUBLE + 0.45::DOUBLE * mean_relevance + 0.20::DOUBLE * least(1.0::DOUBLE, 3 / 8.0::DOUBLE) + 0.15::DOUBLE * least(1.0::DOUBLE, facts / 40.0::DOUBLE)) AS confidence FROM m, n""")
def grounded_confidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = d.select(F.when(F.col("quality").isNotNull(), F.struct(F.col("quality").cast("double").alias("relevance"))).alias("digest"))
    n = facts_of(spark, sf_dir).agg(F.count("*").alias("facts"))
    m = records.mean_relevance(r).join(F.broadcast(n))  # one row each
    return m.withColumn("confidence", records.grounded_confidence(F.col("mean_relevance"), F.lit(3), F.col("facts"), rank.TOP_K))


@query(f"SELECT (SELECT count(*) FROM documents) AS n_queries, (SELECT count(DISTINCT url) FROM {_HITS}) AS n_sources, (SELECT count(*) FROM {_LINES}) AS n_facts")
def corpus_counters(spark, sf_dir):
    h = hits_of(spark, sf_dir)
    one = F.struct("title", "url", "snippet", "source")
    r = h.select(F.col("rec_ord").alias("ord"), F.col("source").alias("query"), F.struct("relevance").alias("digest"), F.array(one).alias("results"))
    return records.counters(r, facts_of(spark, sf_dir))


@query(f"""
WITH p AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS place, fact FROM {_LINES})
SELECT place // 60 AS part, count(*) AS n, CAST(sum(length(fact)) AS BIGINT) AS chars FROM p GROUP BY part""")
def synthesis_chunks(spark, sf_dir):
    """Facts in parts of sixty, as they are brought down before a synthesis."""
    rows = records.placed(facts_of(spark, sf_dir).select("doc_id", "pos", "fact"), ["doc_id", "pos"])
    return rows.groupBy(chunk_number(F.col("place")).alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("fact").cast("long")).alias("chars"))


@query(f"SELECT doc_id, pos, fact, query FROM (SELECT doc_id, pos, fact, source AS query FROM {_LINES})")
def corpus_facts(spark, sf_dir):
    """The facts of a corpus file that many tasks wrote, read back from its lines, in which they have the order of their places."""
    folder = f"{scratch(spark)}/corpus-{uuid.uuid4().hex}"
    facts = facts_of(spark, sf_dir).select("doc_id", "pos", "fact", "query")
    rows = report.values("facts", facts, ["doc_id", "pos"], F.struct("doc_id", "pos", "fact", "query"))
    sink.write(rows, ["k0", "k1"], [{"path": f"{folder}/corpus.json", "text": json.dumps({"slug": "facts", "facts": sink.mark("facts")}, indent=2), "form": "json"}], folder, report.__name__)
    lines = spark.read.text(f"{folder}/corpus.json").where(F.startswith("value", F.lit("    {")))
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), "doc_id long, pos int, fact string, query string").alias("r")).select("r.*")

"""Text functions, goals and HTML parsers on cases worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from loomquest.functions import goals, html
from loomquest.functions import text as X


def column(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.withColumn("x", f(F.col("v"))).orderBy("i").collect()]


def test_list_item(spark):
    got = column(spark, X.list_item, ["- Foo,", "3D printing", "1984", " 2) “Bar”;", "• baz:", "* a.b."])
    assert got == ["Foo", "D printing", "", "Bar”", "baz", "a.b."]


def test_mention_key(spark):
    assert column(spark, X.mention_key, ["The Oud (lute)", "an  Erhu.", "“A”", "Theremin;"]) == ["oud", "erhu", "a", "theremin"]


def test_query_key_and_slug(spark):
    assert column(spark, X.query_key, ["Indonesian  gamelan!", None, "  é a "]) == ["indonesian gamelan", "", "a"]
    long = "a" * 47 + " bc"
    assert column(spark, X.slug, ["List of X!", "", long]) == ["list-of-x", "search", "a" * 47] == [goals.slug(v) for v in ["List of X!", "", long]]


def test_build_query(spark):
    f = lambda c: X.build_query(c, F.lit("Ada"))
    got = column(spark, f, ["She wrote [1] the first (sic) program, then more of them.", "ada did", " ".join("abcdefghijklmnopqrstuvwxyz")])
    assert got == ["Ada She wrote the first program, then more of them", "ada did", " ".join("abcdefghijklmnopqr")]


def test_facet_query(spark):
    assert column(spark, X.facet_query, ["1. 'big  cats'", "- x\ty", None]) == ["big cats", "x y", ""]


def test_goal_tokens_match_on_both_sides(spark):
    g = ["List of the Overused words in AI text", "what is 3d", None]
    assert column(spark, X.goal_tokens, g) == [goals.tokens(x) for x in g]


def test_hosts_keep_their_port(spark):
    assert column(spark, X.url_host, ["http://a.b:80/x?y", "https://c#d", "nothing", None]) == ["a.b:80", "c", "", ""]


def test_quoted_like_urllib(spark):
    from urllib.parse import quote

    values = ["a b/c", "é&=?", "x~y*z_.-", "100%"]
    assert [v.replace("*", "%2A") for v in column(spark, X.quoted, values)] == [quote(v) for v in values]


def test_followable(spark):
    got = column(spark, X.followable, ["https://a.b/c", "https://x.com/i", "https://a.b/c.PDF?x", "https://a.b/feed/", "", None, "mailto:a@b"])
    assert got == [True, False, False, False, False, False, False]


def test_mentions_kept(spark):
    assert column(spark, lambda c: X.is_mention(c, F.lower(c)), ["Oud", "a", "12", "References", "Sign in", "Oud | lute", "why?"]) == [True, False, False, False, False, False, False]


def test_page_text_drops_blocks(spark):
    page = "<head>x</head><nav>menu</nav><p>One &amp; <b>two</b></p>\n \n\n<script>s</script> three"
    assert column(spark, X.page_text, [page, None]) == ["One &amp; two \n three".replace(" \n", " \n"), ""]


@pytest.mark.parametrize(
    ("goal", "listing", "census", "entity", "scope"),
    [
        ("list every musical instrument ever mentioned on the net", True, True, "musical instrument", "exhaustive"),
        ("a complete list of banned words", True, True, "banned words", "exhaustive"),
        ("where can I buy every book", True, False, "where can I buy every book", "quick"),
        ("the list of best laptops", True, False, "best laptops", "quick"),
        ("history of tea", False, False, "history of tea", "quick"),
        ("", False, False, "", "quick"),
        ("names of cats", True, True, "names of cats", "quick"),
    ],
)
def test_goals(goal, listing, census, entity, scope):
    assert (goals.is_enumerable(goal), goals.suits_census(goal), goals.entity(goal), goals.scope(goal)) == (listing, census, entity, scope)
    assert goals.scope(goal, "broad") == "broad"


def test_facets():
    got = goals.facet_queries("quad mesh", 5)
    assert got == ["quad mesh", "quad mesh overview", "quad mesh explained", "quad mesh history", "quad mesh how it works"]
    assert goals.facet_queries("s", 6, ["A b", "a B", "c", "d"]) == ["A b", "c", "d"]


def test_items():
    assert html.items("<ul><li>foo <code>bar</code> baz</li><li>two</li></ul><nav><li>no</li></nav><h2>&eacute;t&eacute;</h2><td> </td>") == ["bar", "baz", "two", "été"]
    assert html.items("<li>open<li>more</li>") == ["more"] and html.items(None) == []


def test_links():
    page = '<a href="/a#x">A</a><a>self</a><a href="//h.c/b">B</a><a href="mailto:x">m</a><a href="/a">again</a>'
    assert html.links(page, "https://e.org/d/") == [{"url": "https://e.org/a", "anchor": "A"}, {"url": "https://e.org/d/", "anchor": "self"}, {"url": "https://h.c/b", "anchor": "B"}]


def test_parts_are_what_the_single_functions_give(spark):
    odd = ["", None, "<p>a&nbsp;&nbsp; b\r\n \n\x0b\nc &lt;li&gt; &amp;amp; </p><li>x</li>", "<nav>n <a href='/q'>Q</a></nav><li>y<script>s</nav></script></li>", "<script x><li>z</li>", "\u00a0 é <b", "a < b > c"]
    rows = [(r.html, r.url) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + [(x, "http://h/") for x in odd]
    df = spark.createDataFrame(rows, "html string, url string").repartition(3)
    text = F.left(X.trim(X.squeeze_lines(html.unescape(X.page_text(F.col("html"), None)))), F.lit(900))
    got = df.select("html", html.page_parts(F.col("html"), F.col("url"), 900, True, True).alias("p"), text.alias("text"), html.page_items("html").alias("items"), html.page_links("html", "url").alias("links")).collect()
    assert all((r.p.text, r.p["items"], r.p.links) == (r.text, r["items"], r.links) for r in got) and len(got) == len(rows)
    assert html.parts("<li>a</li>", "u", None, False, False) == ("a", [], [])


def test_marks_of_odd_pages():
    assert html.items("</li><li>a</li>b</li><td>c<li>d</td>e</li>f</li>") == ["a", "d", "e"]
    assert html.links('<a href="/x">one<a href="/y">two</a></a><a href="/z">open', "http://h/") == [{"url": "http://h/y", "anchor": "two"}]


def test_blocks_that_never_close_cost_little():
    import time

    page = "<script x>" * 100_000 + "<header>gone</header><li>kept</li>"
    start = time.perf_counter()
    assert html.without(["script", "head", "header"], page).endswith("<script x> <li>kept</li>")
    assert html.without(["script"], "<script " * 100_000) == "<script " * 100_000 and time.perf_counter() - start < 5
    for page in ["<HEADER a>x</header>y<head>z</HEAD>w", "<header>x</header>y", "a<nav>b</nav c><nav>d</nav>e", "<head", "<nav>open <head>x</head>"]:
        assert html.without(["head", "nav", "header"], page) == re.sub(r"(?is)<(head|nav|header)[^>]*>.*?</\1>", " ", page)


@pytest.mark.parametrize(
    ("reply", "value"),
    [("[1]", [1]), ('so: {"a": [1]} end', {"a": [1]}), ("```json\n[\"x\"]\n```", ["x"]), ("none", None), (None, None), ("x [1, 2] {", [1, 2])],
)
def test_salvage(reply, value):
    assert html.salvaged(reply) == value

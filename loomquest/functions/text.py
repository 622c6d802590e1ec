"""Scalar functions on text, as Column expressions that stay in the JVM.

White space is named character by character (Java's \\s is ASCII): SPACE. Lengths and cuts are in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomquest.functions import patterns as P

SPACE = " \t\r\n\f\x0b"
RUN = "[ \\t\\r\\n\\f\\x0B]+"


def held(rows, **values: Column):
    """rows with columns behind a generator, which filters do not move through: the optimiser would else write the whole expressions into
    every use that a filter makes of them."""
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("__held")
    kept = [c for c in rows.columns if c not in values]
    return rows.select(*kept, made).select(*kept, "__held.*")


def trim(c: Column, chars: str = SPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, RUN, " ")


def strip_tags(c: Column) -> Column:
    """Text without tags, trimmed; entities are left to html.unescape()."""
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))


def build_query(claim: Column, anchor: Column | None = None, words: int = 18) -> Column:
    """A claim as a search query: bracketed parts go, spaces are squeezed, edge punctuation is cut, and the first words stay. A query that
    starts with a pronoun or is shorter than six words gets the anchor in front, unless it holds it."""
    q = F.btrim(squeeze(F.regexp_replace(claim, r"\[[^\]]*\]|\([^)]*\)", " ")), F.lit(" -—.?!,"))
    if anchor is not None:
        short = F.size(F.filter(F.split(q, " "), lambda w: w != "")) < 6
        wanted = (anchor != "") & (q.rlike(P.PRONOUN) | short) & ~F.contains(F.lower(q), F.lower(anchor))
        q = F.when(F.coalesce(wanted, F.lit(False)), F.concat(anchor, F.lit(" "), q)).otherwise(q)
    return F.array_join(F.slice(F.filter(F.split(q, RUN), lambda w: w != ""), 1, words), " ")


def facet_query(c: Column) -> Column:
    """A model's or facet's query without list marks or quotes, squeezed."""
    return squeeze(F.btrim(trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^[ \\t\\r\\n\\f\\x0B0-9.)*\"'-]+", "")), F.lit("\"'")))


def list_item(fact: Column) -> Column:
    """A fact as an item of a list: list marks in front, quotes around and separators behind go."""
    v = trim(F.ltrim(trim(fact), F.lit("-*0123456789.)• \t")))
    return F.rtrim(F.btrim(v, F.lit("\"'“”’")), F.lit(",;:"))


def mention_key(item: Column) -> Column:
    """The key under which mentions of one entity meet: no parentheses, edge marks or leading article, lower case."""
    v = F.rtrim(F.btrim(trim(F.regexp_replace(item, r"\([^)]*\)", "")), F.lit("\"'“”’")), F.lit(",;:."))
    return F.lower(trim(F.regexp_replace(v, f"(?i)^(the|a|an){RUN}", "")))


def query_key(q: Column) -> Column:
    """The key under which two spellings of a query meet."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), "[^a-z0-9]+", " "))


def goal_tokens(goal: Column) -> Column:
    """Distinct runs of three or more ASCII letters and digits that are not stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(goal, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in P.STOP_WORDS]))


def overlap(tokens: list[str], text: Column) -> Column:
    """How many of the tokens occur in text, as parts of words too. One contains() per token: no join, no lambda."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in tokens], F.lit(0))


def slug(c: Column) -> Column:
    s = F.btrim(F.left(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit(48)), F.lit("-"))
    return F.when(s == "", "search").otherwise(s)


def url_host(url: Column) -> Column:
    """The authority of a URL, with its port; '' where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def quoted(c: Column) -> Column:
    """Percent-encoding that keeps '/' and writes spaces as %20."""
    return reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), [("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")], F.url_encode(c))


def followable(url: Column) -> Column:
    return F.coalesce((url != "") & ~url.rlike(P.SHARE) & ~url.rlike(P.BAD_FILE), F.lit(False))


def is_junk(low: Column) -> Column:
    """P.JUNK on a lower-cased text, by searches for plain texts and one anchored pattern, which costs a fraction of the one long alternation."""
    plain = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in P.JUNK_TEXTS])
    return plain | F.endswith(F.rtrim(low, F.lit(SPACE)), F.lit("?")) | low.rlike(P.JUNK_WHOLE)


def is_item(v: Column, low: Column) -> Column:
    """Whether a text can be an item of a list; low is it in lower case."""
    return F.length(v).between(1, 120) & ~is_junk(low)


def is_mention(v: Column, low: Column) -> Column:
    """Whether a trimmed text can be a mention."""
    return (F.length(v) >= 2) & v.rlike("[A-Za-z]") & ~is_junk(low) & ~v.rlike(P.META)


def list_bonus(title: Column, strong: float, weak: float) -> Column:
    return F.when(title.rlike(P.LIST_TITLE), strong).when(title.rlike(P.LIST_HINT), weak).otherwise(0.0)


def page_text(html: Column, cap: int | None = 12_000) -> Column:
    """The text of a page before entities are resolved: closed blocks and tags become spaces, runs of spaces and of line ends one. cap: code points."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, "(?is)<(" + "|".join(P.CLOSED_BLOCKS) + ")[^>]*>.*?</\\1>", " ")
    t = trim(squeeze_lines(F.regexp_replace(t, "<[^>]+>", " ")))
    return F.left(t, F.lit(cap)) if cap else t


def squeeze_lines(t: Column) -> Column:
    """Runs of spaces become one, runs of blank lines one line end."""
    return F.regexp_replace(F.regexp_replace(t, "[ \\t\\r\\f\\x0B]+", " "), "\\n[ \\t\\r\\n\\f\\x0B]*\\n", "\n")

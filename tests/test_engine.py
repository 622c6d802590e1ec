"""Backends, fetching, campaigns and the tool surface, on recorded answers. Nothing here touches a network."""

import json
import re
import sys
from dataclasses import dataclass
from urllib.parse import quote

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomquest import cli, tools
from loomquest.models import clients, tasks
from loomquest.plans import campaign, census, lock, report
from loomquest.plans.engine import Engine, pages
from loomquest.sources import backends as B
from loomquest.sources import cache, files, sink, transport
from loomquest.sources.hits import Hits
from loomquest.sources.transport import Fixture

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/1</id><title> T </title><summary>a\n  b</summary></entry></feed>'
DDG = '<a rel="n" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc+d&x=1">One <b>two</b> &amp; 3</a><a class="result__snippet" href="x">snip</a><a class="result__a" href="javascript:x">no</a>'
LITE = '<a rel="n" href="https://l.m/n" class="result-link">Lite</a><a href="https://duckduckgo.com/y" class="result-link">own</a>'

ANSWERS = [
    ("ddg", DDG, ("One two & 3", "https://a.b/c+d", "snip", "ddg")),
    ("ddg", LITE, ("Lite", "https://l.m/n", "", "ddg")),
    ("marginalia", {"results": [{"url": "u", "title": "", "description": "<b>d</b>"}, {"title": "no"}]}, ("u", "u", "d", "marginalia")),
    ("mojeek", {"response": {"results": [{"link": "u", "title": "t", "desc": "d"}]}}, ("t", "u", "d", "mojeek")),
    ("mojeek", {"results": [{"url": "u", "description": "d"}]}, ("u", "u", "d", "mojeek")),
    ("wiki", {"query": {"search": [{"title": "A b/c", "snippet": "x <span>y</span>"}]}}, ("Wikipedia: A b/c", "https://en.wikipedia.org/wiki/A_b/c", "x y", "wiki")),
    ("crossref", {"message": {"items": [{"DOI": "10/1", "title": ["T"], "container-title": ["J"]}]}}, ("T", "https://doi.org/10/1", "J", "crossref")),
    ("arxiv", ATOM, ("T", "http://arxiv.org/1", "a b", "arxiv")),
    ("semanticscholar", {"data": [{"url": "u", "title": "t", "year": 1999, "abstract": "z" * 500}]}, ("t (1999)", "u", "z" * 400, "s2")),
    ("openalex", {"results": [{"id": "i", "doi": None, "display_name": "n", "primary_location": {"source": {"display_name": "V"}}}]}, ("n", "i", "V", "openalex")),
    ("hn", {"hits": [{"objectID": "7", "title": "t", "points": 3}]}, ("t", "https://news.ycombinator.com/item?id=7", "HN: 3 points, 0 comments", "hn")),
    ("stackexchange", {"items": [{"link": "u", "title": "a &lt; b", "tags": list("abcdef"), "score": 2, "answer_count": 1}]}, ("a < b", "u", "score 2, 1 answers [a, b, c, d, e]", "stack")),
    ("github", {"items": [{"full_name": "o/r", "html_url": "u", "description": "d", "stargazers_count": 5}, {"full_name": "x"}]}, ("o/r", "u", "d  ★5", "github")),
    ("searxng", {"results": [{"url": "u", "title": "t", "content": "c", "engine": "e"}]}, ("t", "u", "c", "searx:e")),
]


@pytest.mark.parametrize("body", ["", "not it", "{}", "[]", '{"results": null}'])
def test_bad_answers_give_nothing(spark, body):
    rows = spark.createDataFrame([(0, "q", i, n, body) for i, n in enumerate(B.BACKENDS)], "ord long, query string, backend_ord int, backend string, body string")
    assert B.parsed(rows, 5).collect() == []


def test_every_backend_parses(spark):
    rows = [(i, "q", 0, name, body if isinstance(body, str) else json.dumps(body)) for i, (name, body, _) in enumerate(ANSWERS)]
    got = B.parsed(spark.createDataFrame(rows, "ord long, query string, backend_ord int, backend string, body string"), 5).collect()
    assert {r.ord: (r.title, r.url, r.snippet, r.source) for r in got} == {i: want for i, (*_, want) in enumerate(ANSWERS)} and len(got) == len(ANSWERS)


def test_resolution(monkeypatch):
    monkeypatch.delenv("LOOM_MOJEEK_KEY", raising=False)
    assert B.resolve(["tech", "hn", "nobody"]) == ["hn", "stackexchange", "github"] and B.resolve([]) == B.DEFAULTS and B.resolve(["mojeek"]) == B.DEFAULTS
    monkeypatch.setenv("LOOM_MOJEEK_KEY", "k")
    assert "mojeek" in B.resolve(["all"])


def requests(spark, urls):
    return spark.createDataFrame([(str(i), i, u, "GET", "", None) for i, u in enumerate(urls)], "key string, ord long, url string, method string, form string, headers map<string,string>")


def test_breaker_and_states_across_waves(spark):
    t = Fixture({"http://a/": "ok", "http://b/": 429, "http://c/": 403, "http://d/": None})
    urls = [f"http://{h}/" for h in "aabbbbccdd"]
    policies = {"c": transport.Policy(ban_prone=True), "a": transport.Policy(cap=3)}
    rows = transport.fetched(requests(spark, urls), t, policies).cache()
    sent = {h: s for h, s in transport.host_states(rows).items()}
    assert sent["a"][:2] == (2, 0) and sent["b"][:2] == (3, 3) and sent["b"][3] and sent["c"][:2] == (1, 1) and sent["c"][3] and sent["d"][:2] == (2, 0) and not sent["d"][3]
    again = transport.host_states(transport.fetched(requests(spark, ["http://a/"] * 3 + ["http://c/"]), t, policies, sent))
    assert again["a"][0] == 3 and again["a"][3] and again["c"][0] == 1
    assert transport.safety(again)["tripped"] == ["a", "c"]


def test_gap_is_kept():
    """The waits of one host, on a clock of its own."""
    import pandas as pd

    class Clock(Fixture):
        def sleep(self, seconds):
            self.asked.append(round(seconds, 3))

    c = Clock({"http://a/": "x"})
    captured = {}

    class Frame:
        def __getattr__(self, name):
            def f(*a, **k):
                if name == "mapInPandas":
                    captured["run"] = a[0]
                return self

            return f

        sparkSession = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k: "4")})})

    import unittest.mock

    with unittest.mock.patch.object(transport, "host_of", lambda u: u), unittest.mock.patch.object(transport.F, "col", lambda c: c):
        transport.fetched(Frame(), c, {"a": transport.Policy(5.0)})
    frame = pd.DataFrame({"key": ["1", "2"], "host": ["a", "a"], "url": ["http://a/"] * 2, "method": "GET", "form": "", "headers": [None, None]})
    list(captured["run"]([frame]))
    waits = [x for x in c.asked if isinstance(x, float)]
    assert waits[0] == pytest.approx(transport.jitter("a")) and waits[1] >= 4.9


def hn(*pairs):
    return json.dumps({"hits": [{"url": u, "title": t} for u, t in pairs]})


def page(*entries, links=()):
    filler = "word " * 60
    return f"<body><p>{filler}</p><ul>{''.join(f'<li>{e}</li>' for e in entries)}</ul>{''.join(f'<a href={chr(34)}{u}{chr(34)}>{t}</a>' for u, t in links)}</body>"


def hn_url(q, n=6):
    return f"https://hn.algolia.com/api/v1/search?tags=story&hitsPerPage={n}&query={quote(q)}"


def engine(spark, tmp_path, answers, **more):
    return Engine(spark, str(tmp_path / "out"), transport=Fixture(answers), settings={}, **more)


WORDS = {
    hn_url("banned words"): hn(("http://p1/", "banned words list"), ("http://p2/", "words")),
    hn_url("more words"): hn(("http://p2/", "again"), ("http://p3/", "banned things")),
    "http://p1/": page("delve", "tapestry", "Read more", links=[("http://p4/banned", "banned words"), ("http://p9/x", "off")]),
    "http://p2/": page("Delve,", "realm"),
    "http://p3/": page("realm", "delve"),
    "http://p4/banned": page("tapestry", "unique"),
}


def test_campaign_without_model(spark, tmp_path):
    e = engine(spark, tmp_path, WORDS)
    c = campaign.run(e, "list of banned words", "w", ["banned words", "more words"], names=["hn"])
    assert c["report"]["key_findings"] == ["delve", "realm", "tapestry", "unique"] and "3 of them stand in two or more sources" in c["report"]["answer"]
    assert (c["n_queries"], c["n_sources"], c["n_deep_read"], c["n_discovered"]) == (2, 3, 4, 1) and c["safety"]["requests"]["hn.algolia.com"] == 2
    p = report.paths(e.folder, "w")
    assert "## Items: 4" in p["report"].read_text() and "## more words\n\nHits: 2." in p["results"].read_text() and json.loads(p["json"].read_text())["slug"] == "w"
    assert lock.holder(e.folder) is None


def test_resume_asks_nothing_twice(spark, tmp_path):
    a = engine(spark, tmp_path, WORDS)
    campaign.run(a, "list of banned words", "w", ["banned words"], names=["hn"], deep=False)
    b = engine(spark, tmp_path, WORDS)
    c = campaign.run(b, "list of banned words", "w", ["banned words", "more words"], names=["hn"], deep=False)
    assert b.safety()["requests"] == {"hn.algolia.com": 1} and c["n_queries"] == 2
    assert campaign.run(engine(spark, tmp_path, {}), "list of banned words", "w", ["banned words", "more words"], names=["hn"], deep=False)["n_facts"] == 0


def test_cache_serves_and_keeps_no_empties(spark, tmp_path):
    path = str(tmp_path / "cache")
    q = spark.createDataFrame([(0, "banned words"), (1, "nothing")], "ord long, query string")
    a = engine(spark, tmp_path, WORDS | {hn_url("nothing"): '{"hits": []}'}, cache_path=path)
    assert a.search(q, ["hn"]).count() == 2
    assert cache.read(spark, path).count() == 1 and cache.read(spark, path, ttl=-5).count() == 0
    b = engine(spark, tmp_path, {}, cache_path=path)
    assert b.search(q, ["hn"]).count() == 2 and b.safety()["requests"] == {"hn.algolia.com": 1}


def test_a_lookup_reads_its_buckets_and_compaction_keeps_the_latest(spark, tmp_path, capfd):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(f"{i * 7919 % 4096:03x}{i:017d}", f"body {i}") for i in range(3000)], "key string, body string")
    cache.store(rows, path)
    wanted = rows.where("body in ('body 1', 'body 2', 'body 3', 'body 5', 'body 8', 'body 13', 'body 21', 'body 34', 'body 55', 'body 89')")
    got = cache.read(spark, path, keys=wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    got.explain("formatted")
    filters = re.search(r"PartitionFilters: \[(.*)\]", capfd.readouterr().out).group(1)
    assert set(re.findall(r"\b[0-9a-f]{2}\b", filters)) == {r.key[:2] for r in wanted.collect()}  # ten keys, ten buckets
    for n in range(4):
        cache.store(rows.where("body = 'body 1'").withColumn("body", F.lit(f"newer {n}")), path)
    before = {f for f in spark.read.parquet(path).inputFiles()}
    key = rows.where("body = 'body 1'").first().key
    assert cache.compacted(spark, path, most=3) == 1 and cache.compacted(spark, path, most=3) == 0
    after = {f for f in spark.read.parquet(path).inputFiles()}
    assert len([f for f in after if f"bucket={key[:2]}" in f]) == 1 and {f for f in before if f"bucket={key[:2]}" not in f} <= after
    assert cache.read(spark, path, keys=rows.where("body = 'body 1'")).first().body == "newer 3" and cache.read(spark, path).count() == 3000


def test_second_address_and_summaries(spark, tmp_path):
    q = spark.createDataFrame([(0, "cats")], "ord long, query string")
    wiki = "https://en.wikipedia.org/w/api.php?action=query&list=search&format=json&srlimit=6&srsearch=cats"
    e = engine(spark, tmp_path, {"https://html.duckduckgo.com/html/": 202, "https://lite.duckduckgo.com/lite/": LITE, wiki: json.dumps({"query": {"search": [{"title": "Cat", "snippet": "s"}, {"title": "Dog", "snippet": "d"}]}}),
                                 "https://en.wikipedia.org/api/rest_v1/page/summary/Cat": '{"extract": "A cat."}'})
    got = [(r.url, r.snippet) for r in e.search(q, ["ddg", "wiki"]).orderBy("hit_ord").collect()]
    assert got == [("https://l.m/n", ""), ("https://en.wikipedia.org/wiki/Cat", "A cat."), ("https://en.wikipedia.org/wiki/Dog", "d")]
    assert e.safety()["tripped"] == ["html.duckduckgo.com"]


def test_campaign_with_model(spark, tmp_path):
    answers = {
        "DISTIL": '{"summary": "s", "facts": ["tea is old"], "relevance": "high"}',
        "READ": 'Sure: {"facts": ["tea is from Asia"]}',
        "SYNTHESISE": '```json\n{"answer": "Tea.", "key_findings": "one", "open_questions": [], "confidence": 1}\n```',
    }
    web = {hn_url("tea history"): hn(("http://p1/", "tea")), "http://p1/": page("x")}
    c = campaign.run(engine(spark, tmp_path, web, client=clients.Scripted(answers)), "history of tea", "t", ["tea history"], names=["hn"])
    assert [f["fact"] for f in c["facts"]] == ["tea is old", "tea is from Asia"] and c["report"]["key_findings"] == ["one"]
    assert c["report"]["confidence"] == round(0.20 + 0.20 / 8 + 0.15 * 2 / 40, 2)


def test_synthesis_in_parts(spark):
    facts = spark.createDataFrame([(i, f"fact {i}") for i in range(130)], "place long, fact string")
    one = clients.Scripted({"fact 0\n": '{"answer": "a", "key_findings": ["first"]}', "fact 60\n": '{"key_findings": ["second"]}', "fact 129": "garbage", "first\n- second": '{"answer": "done", "key_findings": ["f"]}'})
    assert tasks.synthesised(facts, "g", one)["answer"] == "done"
    assert tasks.synthesised(facts, "g", clients.Offline()) is None


@dataclass
class Short(clients.Scripted):
    """Refuses prompts of more facts than a part has."""

    def ask(self, prompt, want_json=False, model=None):
        lines = [ln for ln in prompt.split("\n") if ln.startswith("- ")]
        assert len(lines) <= tasks.CHUNK
        return json.dumps({"answer": f"of {len(lines)}", "key_findings": [lines[0][2:] + "+", lines[-1][2:]]})


def test_synthesis_in_levels(spark):
    """5,000 facts: 84 parts, then 168 findings in 3 parts, then 6 in one."""
    facts = spark.range(5000).selectExpr("id as place", "concat('fact ', id) as fact").repartition(7)
    assert tasks.synthesised(facts, "g", Short())["answer"] == "of 6"
    assert tasks.synthesised(facts, "g", Short())["key_findings"] == ["fact 0+++", "fact 4999"]


def test_shares_of_a_rate_keep_the_gap_together(monkeypatch):
    """Tasks on one clock, each with slots of its own: all calls together are a gap apart."""
    class Clock:
        now = 1000.3

        def time(self):
            return self.now

        def sleep(self, seconds):
            self.now += max(0.0, seconds)

    calls = []
    for turn in range(4):
        clock = Clock()
        clock.now += turn * 0.37  # tasks start at any time
        monkeypatch.setattr(clients, "time", clock)
        own = clients.Gemini("k", gap=1.1).sharing(4, turn)
        for k in range(6):
            own._wait()
            calls.append(clock.now)
            clock.now += 0.2 * (k % 3)  # an answer takes a while
    calls.sort()
    assert all(b - a >= 1.1 - 1e-6 for a, b in zip(calls, calls[1:], strict=False))
    assert calls[-1] - calls[0] < 1.1 * 4 * 7


def test_census_to_saturation_and_resume(spark, tmp_path):
    goal = "every banned word"
    queries = {hn_url(q, 6): hn(("http://p1/", "banned words list"), ("http://p2/", "banned")) for q in ["every banned word", "every banned word overview"]}
    e = engine(spark, tmp_path, WORDS | queries)
    c = census.run(e, goal, "c", "broad", ["hn"])
    found = {i["item"]: i["sources"] for i in c["items"]}
    assert found["delve"] == 2 and found["tapestry"] == 2 and found["unique"] == 1 and c["n_rounds"] == 2 and c["report"]["enumerated"]
    assert [r["new_items"] for r in c["records"]][1] == 0 and c["records"][-1]["total_items"] == len(found)
    assert f"after round 2: {len(found)} items, 0 of them new" in tools.read_campaign(e.folder, {"slug": "c"})
    again = census.run(engine(spark, tmp_path, WORDS | queries), goal, "c", "broad", ["hn"])
    assert {i["item"]: i["sources"] for i in again["items"]} == found and again["n_rounds"] >= 2


def test_pages_that_say_nothing_go(spark):
    raw = spark.createDataFrame([(0, "http://a/", "t", "<p>short</p>"), (1, "http://a/", "t", "<li>item</li>"), (2, "http://a/", "t", "<p>" + "&eacute; " * 201 + "</p>")], "ord long, url string, title string, html string")
    got = {r.ord: r.text for r in pages(raw).collect()}
    assert set(got) == {1, 2} and got[2].startswith("é é")


def test_the_sink_writes_whole_files_or_none(spark, tmp_path):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 'a', 'b') as section", "id as k0", "concat('{\"n\":', id, '}') as value").repartition(7)
    target = {"path": str(tmp_path / "c.json"), "text": json.dumps({"x": 1, "a": sink.mark("a"), "in": {"b": sink.mark("b"), "none": sink.mark("none")}}), "form": "json"}
    sink.write(rows, ["k0"], [target], str(tmp_path), "loomquest.plans.report")
    want = {"x": 1, "a": [{"n": i} for i in range(2000) if i % 3 == 0], "in": {"b": [{"n": i} for i in range(2000) if i % 3], "none": []}}
    assert json.loads((tmp_path / "c.json").read_text()) == want and sorted(p.name for p in tmp_path.iterdir()) == ["c.json"]
    broken = rows.withColumn("value", F.when(F.col("k0") == 1500, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        sink.write(broken, ["k0"], [target], str(tmp_path), "loomquest.plans.report")
    with pytest.raises(Exception, match="no_such_form"):
        sink.write(rows.limit(5), ["k0"], [target | {"form": "no_such_form"}], str(tmp_path), "loomquest.plans.report")
    assert json.loads((tmp_path / "c.json").read_text()) == want


def test_lock(tmp_path):
    with lock.held(str(tmp_path), "a"):
        assert lock.holder(str(tmp_path))["slug"] == "a"
        with pytest.raises(lock.Busy), lock.held(str(tmp_path), "b"):
            pass
    assert lock.holder(str(tmp_path)) is None
    (tmp_path / ".campaign.lock").write_text('{"slug": "x", "pid": 999999999, "started": 9e12}')
    assert lock.holder(str(tmp_path)) is None and not (tmp_path / ".campaign.lock").exists()


def test_tools(spark, tmp_path):
    e = engine(spark, tmp_path, WORDS)
    with pytest.raises(ValueError, match="query"):
        tools.web_search(e, {})
    assert tools.web_search(e, {"query": "banned words", "backends": "hn"}).startswith("banned words: 2 hits by hn\nHosts: 1 asked, 1 requests, no host had to be dropped.\n1. banned words list\n   from hn: http://p1/")
    assert tools.read_campaign(e.folder, {"slug": "none"}).startswith("There is no campaign 'none', nor any other")
    tools.run_campaign(e, {"question": "banned words", "backends": "hn", "queries": 1, "scope": "quick"})
    assert tools.read_campaign(e.folder, {"slug": "banned words"}).startswith("# banned words\n")
    assert "exhaustive census of \"cat\"" in tools.plan({"question": "list every cat"}, e.folder) and "12 queries" in tools.plan({"question": "cats and dogs"}, e.folder)
    assert tools.read_campaign(e.folder, {"slug": "none"}) == "There is no campaign 'none'; there are: banned-words."


def test_the_end_is_marked_however_it_comes(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path, WORDS)
    monkeypatch.setattr(campaign, "run", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tools.run_campaign(e, {"question": "banned words", "backends": "hn", "scope": "quick"})
    report.paths(e.folder, "banned-words")["trace"].write_text("x" * 600 + "\nlast words")
    said = tools.read_campaign(e.folder, {"slug": "banned words"})
    assert said.startswith("banned-words is over (failed: ZeroDivisionError") and said.endswith("last words") and len(said) < 700


def test_progress_is_told(spark, tmp_path):
    said = []
    campaign.run(engine(spark, tmp_path, WORDS, say=said.append, workers=2), "list of banned words", "w", ["banned words", "more words"], names=["hn"], deep=False)
    assert said == ["2 of 2 queries asked"]


def test_a_census_goes_on_from_its_corpus_file(spark, tmp_path):
    e = engine(spark, tmp_path, WORDS | {hn_url(q, 6): hn(("http://p1/", "banned words list")) for q in ["every banned word overview"]})
    corpus = {"mode": "census", "items": [{"item": "Delve", "sources": 3, "vetted": True}, {"item": "oldword", "sources": 1}], "done_queries": ["every banned word"], "seen_urls": ["http://p2/"]}
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "c.json").write_text(json.dumps(corpus))
    c = census.run(e, "every banned word", "c", "broad", ["hn"])
    found = {i["item"]: (i["sources"], i["vetted"]) for i in c["items"]}
    assert found["Delve"] == (4, True) and found["oldword"] == (1, False) and found["tapestry"] == (2, False)
    assert "every banned word" in c["done_queries"] and "http://p2/" in c["seen_urls"] and e.safety()["requests"].get("p2") is None


def test_command_line(capsys, tmp_path, monkeypatch):
    monkeypatch.setenv("LOOM_BACKEND", "offline")
    (tmp_path / "My list.txt").write_text("# note\none\n\n two \n")
    assert cli.inputs(cli.parser().parse_args(["--file", str(tmp_path / "My list.txt")]), clients.Offline()) == (["one", "two"], "one", "my-list")
    cli.main(["quad", "mesh", "--queries", "3", "--dry-run"])
    assert "quad mesh overview" in capsys.readouterr().out


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# c\n a \n\nb\n")
    assert [r.query for r in files.query_file(spark, str(tmp_path / "q.txt")).orderBy("ord").collect()] == ["a", "b"]
    (tmp_path / "r.jsonl").write_text('{"ord": 1, "query": "x", "results": []}\n\n{"ord": 2, "que\n')
    assert [r.query for r in files.record_log(spark, str(tmp_path / "r.jsonl")).collect()] == ["x"]
    assert files.record_log(spark, str(tmp_path / "none")).collect() == []


def test_output_dir(monkeypatch):
    for value, want in (("", "d"), ("/abs", "/abs"), ("rel", None), ("/x/${Y}", None)):
        monkeypatch.setenv("LOOM_OUT_DIR", value)
        assert files.output_dir("d") == want if want else files.output_dir("d").endswith("loomquest")


def test_data_source(spark):
    spark.dataSource.register(Hits)
    answers = json.dumps({hn_url("cats"): hn(("http://c/", "cat"))})
    df = spark.read.format("hits").option("query", "cats").option("backends", "hn").option("transport", "fixture").option("answers", answers).load()
    assert [(r.url, r.title) for r in B.parsed(df, 6).collect()] == [("http://c/", "cat")]


def test_data_source_keeps_a_hosts_limits(spark):
    """A second address where the first gives no hits, counters that go from load to load, no request to a host that has tripped, and patience where it is asked for."""
    spark.dataSource.register(Hits)
    stack = "https://api.stackexchange.com/2.3/search/advanced?order=desc&sort=relevance&site=stackoverflow&pagesize=6&q=cats"
    answers = {"https://html.duckduckgo.com/html/": "<p>nothing</p>", "https://lite.duckduckgo.com/lite/": LITE, stack: '{"items": [], "backoff": 10}', hn_url("cats"): 403}
    load = lambda **more: spark.read.format("hits").option("query", "cats").option("backends", "ddg,stackexchange,hn").option("transport", "fixture").option("answers", json.dumps(answers)).options(**more).load()
    rows = load()
    assert [r.url for r in B.parsed(rows, 6).collect()] == ["https://l.m/n"]
    states = transport.host_states(rows)
    assert states["html.duckduckgo.com"][0] == states["lite.duckduckgo.com"][0] == 1 and states["api.stackexchange.com"][1:3] == (1, 4.0) and states["hn.algolia.com"][1] == 1
    for _ in range(2):
        states = transport.host_states(load(states=json.dumps(states)))
    assert states["hn.algolia.com"][0] == 3 and states["hn.algolia.com"][3]
    assert transport.host_states(load(states=json.dumps(states)))["hn.algolia.com"][0] == 3


def test_clients(monkeypatch):
    for k in ("LOOM_BACKEND", "LOOMQUEST_BACKEND", "GEMINI_API_KEY"):
        monkeypatch.delenv(k, raising=False)
    none = lambda: None
    assert isinstance(clients.client(none), clients.Offline)
    monkeypatch.setenv("GEMINI_API_KEY", "k")
    assert isinstance(clients.client(none), clients.Gemini)
    monkeypatch.setenv("LOOMQUEST_BACKEND", "local")
    assert clients.client(none).label.startswith("local (ollama:")
    monkeypatch.setenv("LOOM_BACKEND", "offline")
    assert isinstance(clients.client(none), clients.Offline)
    assert tasks.texts("one") == ["one"] and tasks.texts([" a ", ""]) == ["a"] and tasks.number("x") == 0.0

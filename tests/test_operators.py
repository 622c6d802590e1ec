"""Ranking, dedupe, lists, resume and the breaker."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomquest.operators import items, rank, records
from loomquest.streaming import breaker

HITS = "rec_ord long, hit_ord int, query string, relevance double, title string, url string, snippet string, source string"


def hits(spark, rows):
    return spark.createDataFrame([(a, b, "q", rel, t, u, s, "x") for a, b, rel, t, u, s in rows], HITS)


def test_best_occurrence_wins_and_ties_keep_first_place(spark):
    rows = [(0, 0, 0.0, "cats", "u1", ""), (0, 1, 0.0, "cats dogs", "u2", ""), (1, 0, 1.0, "cats", "u1", ""), (1, 1, 0.0, "off", "u3", ""), (2, 0, 0.0, "dogs cats", "u4", ""), (3, 0, 9.0, "", "", "")]
    for parts in (1, 5):
        got = [(r.rank, r.url, r.score) for r in rank.rank_sources(hits(spark, rows).repartition(parts), "cats and dogs", 3).orderBy("rank").collect()]
        assert got == [(1, "u2", 4.0), (2, "u4", 4.0), (3, "u1", 3.0)]


def test_off_topic_counts_only_alone(spark):
    rows = [(0, 0, 0.2, "nothing", "u1", ""), (0, 1, 0.9, "neither", "u2", "")]
    assert [r.url for r in rank.rank_sources(hits(spark, rows), "zebra", 5).orderBy("rank").collect()] == ["u2", "u1"]
    assert [r.url for r in rank.rank_sources(hits(spark, [*rows, (1, 0, 0.0, "a zebra", "u3", "")]), "zebra", 5).collect()] == ["u3"]


def test_list_pages_gain(spark):
    rows = [(0, 0, 0.0, "cats", "u1", ""), (0, 1, 0.0, "50 cats terms", "u2", ""), (0, 2, 0.0, "cats glossary", "u3", "")]
    assert [r.url for r in rank.rank_sources(hits(spark, rows), "list cats", 5, True).orderBy("rank").collect()] == ["u2", "u3", "u1"]


def test_top_sources_use_the_first_record(spark):
    rows = [(0, 0, 0.1, "a", "u1", ""), (1, 0, 0.9, "a", "u1", ""), (2, 0, 0.5, "b", "u2", "")]
    assert [(r.url, r.relevance) for r in rank.top_sources(hits(spark, rows)).orderBy("rank").collect()] == [("u2", 0.5), ("u1", 0.1)]


def test_links_need_topic_and_novelty(spark):
    links = spark.createDataFrame([(0, 0, "http://a/cats", "x"), (0, 1, "http://a/dogs", "y"), (0, 2, "http://a/b", "cats list"), (0, 3, "http://x.com/cats", ""), (1, 0, "http://a/seen", "cats")], "doc_ord long, pos int, url string, anchor string")
    seen = spark.createDataFrame([("http://a/seen",)], "url string")
    assert [r.url for r in rank.discover_links(links, seen, "cats", 6, True).orderBy("rank").collect()] == ["http://a/b", "http://a/cats"]
    assert rank.discover_links(links, seen, "the of", 6).collect() == []


def facts(spark, rows):
    return spark.createDataFrame([(i, f, q) for i, (f, q) in enumerate(rows)], "ord long, fact string, query string")


def test_compiled_list(spark):
    rows = [("- Foo", "a"), ("foo,", "b"), ("Bar", "a"), ("bar", "a"), ("Read more", "a"), ("Read more", "b"), ("x" * 121, "a")]
    got = [(r.item, r.n_sources) for r in items.compiled_list(facts(spark, rows), ["ord"]).orderBy("rank").collect()]
    assert got == [("Foo", 2), ("Bar", 1)]
    many = [(f"item {chr(97 + i)}{chr(97 + j)}", q) for i in range(5) for j in range(6) for q in "ab"] + [("single", "a")]
    kept = items.compiled_list(facts(spark, many), ["ord"]).collect()
    assert len(kept) == 30 and all(r.n_sources == 2 for r in kept) and kept[0].confidence == pytest.approx(0.95)


def test_pages_are_preferred(spark):
    rows = facts(spark, [("a", "q"), ("b", "deep-read: u")])
    assert [r.fact for r in items.prefer_pages(rows).collect()] == ["b"]
    assert items.prefer_pages(rows.where("query = 'q'")).count() == 1


def test_census_state_merges(spark):
    new = lambda rows: spark.createDataFrame(rows, "key string, item string, url string, vetted boolean, ord long")
    first = new([("oud", "Oud", "u1", False, 1), ("oud", "oud", "u2", False, 2)])
    both = {r.key: (r.item, r.sources, r.vetted) for r in items.census_list(first.unionByName(new([("oud", "OUD", "u2", True, 3), ("ney", "Ney", "u3", False, 4)]))).collect()}
    assert both == {"oud": ("Oud", 2, True), "ney": ("Ney", 1, False)}


def test_places_of_rows(spark):
    rows = [(i * 37 % 101, i % 3) for i in range(300)]
    got = records.placed(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(300)) and [(r.a, r.b) for r in got] == sorted(rows)
    assert records.placed(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_replay_over_spans(spark):
    """A busy host's counts go on from hour to hour."""
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, "h" if i % 4 else "g", t0 + datetime.timedelta(minutes=17 * i), "soft" if i % 9 == 0 else "ok") for i in range(60)]
    log = spark.createDataFrame(rows, "event_id int, host string, ts timestamp, signal string")
    seq, blocks, last, want = {}, {}, {}, {}
    for i, h, t, s in rows:
        seq[h] = seq.get(h, 0) + 1
        gap = (t - last[h]).total_seconds() if h in last else None
        want[i] = (seq[h], blocks.get(h, 0), seq[h] <= 30 and blocks.get(h, 0) < 3, 0.0 if gap is None else max(0.0, 3600 - gap))
        blocks[h], last[h] = blocks.get(h, 0) + (s != "ok"), t
    r = {x.event_id: (x.seq, x.blocks_before, x.admitted) for x in breaker.replay(log, 30, ["ts", "event_id"]).collect()}
    w = {x.event_id: x.wait_s for x in breaker.waits(log, 3600.0, ["ts", "event_id"]).collect()}
    assert {i: (*r[i], w[i]) for i in r} == want


def test_saturation(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "a")], "round int, key string")
    assert [(r.round, r.new_items, r.total_items) for r in items.saturation(d).orderBy("round").collect()] == [(1, 2, 2), (2, 0, 2), (3, 1, 3)]


def test_resume(spark):
    q = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "ord long, query string")
    done = spark.createDataFrame([("b", None), ("c", "timeout")], "query string, error string")
    assert [r.ord for r in records.todo(q, done).orderBy("ord").collect()] == [0, 2, 3]
    assert [r.ord for r in records.todo(q, done, normalised=True).orderBy("ord").collect()] == [0, 3]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3", ""]), st.integers(0, 9)), max_size=12))
def test_first_seen_is_idempotent(spark, rows):
    d = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "ord int, url string, v int")
    once = records.first_seen(d, "url", ["ord"])
    want = {}
    for i, (u, v) in enumerate(rows):
        if u:
            want.setdefault(u, (i, u, v))
    assert sorted(map(tuple, once.collect())) == sorted(want.values()) == sorted(map(tuple, records.first_seen(once, "url", ["ord"]).collect()))


def test_signals():
    f = breaker.signal
    assert [f(200, False, True), f(202, False, False), f(429, True, False), f(429, True, True), f(503, True, False), f(404, True, False), f(None, True, True)] == ["ok", "hard", "soft", "hard", "soft", "hard", "error"]
    assert breaker.jitter("html.duckduckgo.com") == 0.014 and breaker.jitter("api.github.com") == 0.332


def test_host_machine():
    h = breaker.HostState(breaker.Policy(2.0, 5))
    for _ in range(2):
        assert h.admit()
        h.observe("soft")
    assert h.gap == 8.0 and not h.tripped
    assert h.admit()
    h.observe("hard")
    assert h.tripped and not h.admit() and h.requests == 3
    prone = breaker.HostState(breaker.Policy(ban_prone=True))
    prone.observe("hard")
    assert prone.tripped
    short = breaker.HostState(breaker.Policy(cap=1))
    assert short.admit() and not short.admit() and short.tripped


def test_replay_and_stream_agree(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"h{r.randrange(6)}", i, r.choice(["ok", "ok", "ok", "soft"])) for i in range(300)]
    log = spark.createDataFrame(rows, "host string, seq long, signal string")
    log.repartition(2).write.json(str(tmp_path / "in"))
    live = breaker.guarded(spark.readStream.schema(log.schema).json(str(tmp_path / "in")), default=breaker.Policy(cap=40))
    q = live.writeStream.format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.host, x.seq): x.admitted for x in spark.sql("select * from guarded").collect()}
    want = {(x.host, x.ord): x.admitted for x in breaker.replay(log.withColumnRenamed("seq", "ord"), 40, ["ord"]).collect()}
    assert got == want and not all(got.values())


def test_confidence_forms(spark):
    one = spark.range(1)
    got = one.select(records.grounded_confidence(F.lit(1.0), F.lit(8), F.lit(100), 8), records.list_confidence(F.lit(0), F.lit(0)), records.list_confidence(F.lit(5), F.lit(10)), records.census_confidence(F.lit(5000))).first()
    assert list(got) == pytest.approx([0.9, 0.0, 0.65, 0.95])

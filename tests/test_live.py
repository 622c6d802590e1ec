"""The stream of live fetches: gaps between requests, records as queries end, and starts after a break. Nothing touches a network."""

import json
import sys
import time
from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark import cloudpickle
from test_engine import LITE, engine, hn, hn_url

from loomquest.plans import campaign
from loomquest.sources import backends as B
from loomquest.sources import files
from loomquest.sources.transport import Fixture
from loomquest.streaming import live
from loomquest.streaming.breaker import Policy

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
QUERIES = ["red cats", "blue cats", "green cats"]
WEB = {hn_url(q): hn((f"http://{q[:3]}/", q)) for q in QUERIES}


@dataclass
class Noted(Fixture):
    """Notes when each address was asked, in a folder that outlives the stream's workers; asked breaks with a fault where it is told to."""

    notes: str = ""
    faulty: tuple = ()

    def ask(self, url, method="GET", form="", headers=()):
        folder = Path(self.notes)
        (folder / f"{time.time_ns()}").write_text(url)
        if any(f in url for f in self.faulty):
            raise RuntimeError("the line is cut")
        return super().ask(url, method, form, headers)


def noted(folder):
    return [(int(p.name) / 1e9, p.read_text()) for p in sorted(Path(folder).iterdir())]


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "notes").mkdir()
    return str(tmp_path / "notes")


@pytest.fixture(autouse=True)
def quick(monkeypatch):
    monkeypatch.setitem(B.POLICIES, "hn.algolia.com", Policy(gap=1.0))


def live_engine(spark, tmp_path, answers, notes, faulty=(), **more):
    e = engine(spark, tmp_path, {}, **more)
    e.transport = Noted(answers, notes=notes, faulty=faulty)
    return e


def test_requests_wait_and_records_come_one_by_one(spark, tmp_path, notes):
    said, seen = [], []
    e = live_engine(spark, tmp_path, WEB, notes)
    e.say = lambda text: (said.append(text), seen.append(files.record_log(spark, f"{e.folder}/w.jsonl").count()))
    before = dict(spark.conf.getAll)
    log = campaign.harvest_live(e, QUERIES, "w", "cats", ["hn"], distil=False)
    assert [(r.query, [h.url for h in r.results]) for r in log.orderBy("ord").collect()] == [(q, [f"http://{q[:3]}/"]) for q in QUERIES]
    times = [t for t, _ in noted(notes)]
    assert len(times) == 3 and all(b - a >= 1.0 for a, b in zip(times, times[1:]))
    assert said == ["0 of 3 queries asked", "1 of 3 queries asked", "2 of 3 queries asked", "3 of 3 queries asked"] and seen == [0, 1, 2, 3]
    assert e.safety()["requests"] == {"hn.algolia.com": 3} and dict(spark.conf.getAll) == before
    campaign.harvest_live(e, QUERIES, "w", "cats", ["hn"], distil=False)
    assert len(noted(notes)) == 3  # nothing is asked when nothing is left


def test_a_break_between_records_loses_and_repeats_none(spark, tmp_path, notes):
    e = live_engine(spark, tmp_path, WEB, notes, ("blue",))
    with pytest.raises(Exception, match="the line is cut"):
        campaign.harvest_live(e, QUERIES, "w", "cats", ["hn"], distil=False)
    assert [r.query for r in files.record_log(spark, f"{e.folder}/w.jsonl").collect()] == ["red cats"]
    again = live_engine(spark, tmp_path, WEB, notes)
    log = campaign.harvest_live(again, QUERIES, "w", "cats", ["hn"], distil=False).collect()
    assert sorted(r.query for r in log) == sorted(QUERIES)
    urls = [u for _, u in noted(notes)]
    assert sum("red" in u for u in urls) == 1 and sum("green" in u for u in urls) == 1
    assert again.safety()["requests"] == {"hn.algolia.com": 3}  # the counters went on, without the request whose batch broke


def test_a_batch_that_runs_again_writes_nothing_twice(spark, tmp_path, notes, monkeypatch):
    """The fault comes after the record is written and before the batch is committed."""
    e = live_engine(spark, tmp_path, WEB, notes)
    append = files.append_records

    def breaks(*a, **k):
        append(*a, **k)
        raise RuntimeError("killed")

    monkeypatch.setattr(files, "append_records", breaks)
    with pytest.raises(Exception, match="killed"):
        campaign.harvest_live(e, QUERIES[:2], "w", "cats", ["hn"], distil=False)
    monkeypatch.setattr(files, "append_records", append)
    log = campaign.harvest_live(live_engine(spark, tmp_path, WEB, notes), QUERIES[:2], "w", "cats", ["hn"], distil=False)
    assert sorted(r.query for r in log.collect()) == sorted(QUERIES[:2])


def test_second_address_summaries_and_the_cache(spark, tmp_path, notes, monkeypatch):
    for host in ("en.wikipedia.org", "html.duckduckgo.com", "lite.duckduckgo.com"):
        monkeypatch.setitem(B.POLICIES, host, Policy(gap=0.1))
    wiki = "https://en.wikipedia.org/w/api.php?action=query&list=search&format=json&srlimit=6&srsearch=cats"
    web = {"https://html.duckduckgo.com/html/": 202, "https://lite.duckduckgo.com/lite/": LITE, wiki: json.dumps({"query": {"search": [{"title": "Cat", "snippet": "s"}, {"title": "Big dog", "snippet": "d"}]}}),
           live.SUMMARY + "Cat": '{"extract": "A cat."}', live.SUMMARY + "Big_dog": 404}
    path = str(tmp_path / "cache")
    log = campaign.harvest_live(live_engine(spark, tmp_path, web, notes, cache_path=path), ["cats"], "w", "cats", ["ddg", "wiki"], distil=False)
    want = [("https://l.m/n", ""), ("https://en.wikipedia.org/wiki/Cat", "A cat."), ("https://en.wikipedia.org/wiki/Big_dog", "d")]
    assert [(h.url, h.snippet) for h in log.first().results] == want
    n = len(noted(notes))
    log = campaign.harvest_live(live_engine(spark, tmp_path, {}, notes, cache_path=path), ["cats"], "other", "cats", ["ddg", "wiki"], distil=False)
    assert [h.url for h in log.first().results] == [u for u, _ in want] and len(noted(notes)) == n


def test_a_host_that_trips_is_left_alone(spark, tmp_path, notes, monkeypatch):
    monkeypatch.setitem(B.POLICIES, "hn.algolia.com", Policy(gap=0.1, ban_prone=True))
    e = live_engine(spark, tmp_path, {hn_url(QUERIES[0]): 403} | WEB | {hn_url(QUERIES[0]): 403}, notes)
    log = campaign.run(e, "cats", "w", QUERIES, names=["hn"], distil=False, deep=False, streamed=True)
    assert log["n_queries"] == 3 and log["n_sources"] == 0 and e.safety()["tripped"] == ["hn.algolia.com"] and len(noted(notes)) == 1


def test_sites_hold_whole_hosts():
    got = live.sites(["a", "b", "c", "d"], {"a": {"x"}, "b": {"y"}, "c": {"x", "z"}, "d": {"z"}})
    assert got["a"] == got["c"] == got["d"] != got["b"]

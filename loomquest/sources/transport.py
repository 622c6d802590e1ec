"""Fetching: one task owns a host and asks it politely, one request at a time.

fetched() repartitions requests by host, so that a host's gap, cap and breaker live in one place. A fetch is a side effect: its rows are written before
they are used, and a wave is never computed twice on purpose. Host counters come back with the rows and go into the next wave."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquest.streaming.breaker import HostState, Policy, jitter, signal

FETCHED = "key string, host string, status int, body string, error string, sent int, blocks int, gap double, tripped boolean"


@dataclass
class Http:
    """The network. Answers are (status, body, error); status is null where no answer came."""

    agent: str = "loomquest/1"
    timeout: float = 20.0

    def ask(self, url, method="GET", form="", headers=()):
        sent = {"User-Agent": self.agent, "Accept-Language": "en-US,en", "Accept-Encoding": "gzip"} | dict(headers)
        if method == "POST":
            sent["Content-Type"] = "application/x-www-form-urlencoded"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=form.encode() if method == "POST" else None, headers=sent), timeout=self.timeout) as r:
                raw = r.read()
                if "gzip" in (r.headers.get("Content-Encoding") or ""):
                    raw = gzip.decompress(raw)
                return r.status or 200, raw.decode("utf-8", "ignore"), None
        except urllib.error.HTTPError as e:
            return e.code, None, f"HTTP {e.code}"
        except (OSError, ValueError) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def sleep(self, seconds):
        time.sleep(seconds)


@dataclass
class Fixture:
    """Recorded answers by URL (and form): a body, a status, or a list of those to be given in turn. Never sleeps; asked holds what a task asked."""

    answers: dict = field(default_factory=dict)
    asked: list = field(default_factory=list)

    def ask(self, url, method="GET", form="", headers=()):
        self.asked.append(url)
        found = self.answers.get(url + ("?" + form if form else ""), self.answers.get(url, 404))
        if isinstance(found, list):
            found = found.pop(0) if len(found) > 1 else found[0]
        if found is None:
            return None, None, "TimeoutError"
        if isinstance(found, int):
            return (found, "", None) if found == 202 else (found, None, f"HTTP {found}")
        return 200, found, None

    def sleep(self, seconds):
        pass


def fetched(requests: DataFrame, transport, policies: dict[str, Policy], states: dict[str, tuple] | None = None, default: Policy | None = None, tasks: int | None = None) -> DataFrame:
    """requests: key, ord, url, method, form, headers (map). Every row is asked, a host's in order of ord; who has alternatives gives them in later waves. Rows: FETCHED, one a
    request made, with the host's counters after it; a host that has tripped gets no request, and its row says so. tasks: hosts asked at a time, at most.

    states: host to (requests, blocks, gap, tripped) of earlier waves, a few numbers a host."""
    before, usual = states or {}, default or Policy()

    def run(frames):
        hosts: dict[str, HostState] = {}
        last: dict[str, float] = {}
        for frame in frames:
            out = []
            for r in frame.itertuples():
                host = r.host
                s = hosts.setdefault(host, HostState(policies.get(host, usual), *before.get(host, (0, 0, 0.0, False))))
                status, body, error = None, None, f"{host} is off for this run"
                if s.admit():
                    transport.sleep(max(0.0, s.gap - (time.monotonic() - last.get(host, -1e9))) + jitter(host))
                    status, body, error = transport.ask(r.url, r.method, r.form, tuple((r.headers or {}).items()))
                    last[host] = time.monotonic()
                    what = signal(status, error is not None, s.policy.ban_prone)
                    s.observe(what)
                    if what == "hard" and error is None:
                        body, error = None, f"status {status}"
                    if asks_to_wait(host, body):
                        s.observe("soft")
                out.append((r.key, host, status, body, error, s.requests, s.blocks, s.gap, s.tripped))
            yield pd.DataFrame(out, columns=["key", "host", "status", "body", "error", "sent", "blocks", "gap", "tripped"]).astype({"status": "Int32"})

    keyed = requests.withColumn("host", host_of(F.col("url")))
    n = max(1, int(tasks or requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(n, "host").sortWithinPartitions("host", "ord").mapInPandas(run, FETCHED)


def asks_to_wait(host: str, body: str | None) -> bool:
    """Whether a good answer asks for patience all the same."""
    return bool(body) and "api.stackexchange.com" in host and '"backoff"' in body


def host_of(url):
    from loomquest.functions.text import url_host

    return url_host(url)


def host_states(rows: DataFrame) -> dict[str, tuple]:
    """What each host's counters are after a wave: one row a host comes to the driver."""
    last = rows.groupBy("host").agg(F.max("sent").alias("sent"), F.max("blocks").alias("blocks"), F.max("gap").alias("gap"), F.max("tripped").alias("tripped"))
    return {r.host: (r.sent, r.blocks, r.gap, r.tripped) for r in last.collect()}


def safety(states: dict[str, tuple]) -> dict:
    """The report on hosts: requests, blocks, and those that are off."""
    return {"requests": {h: s[0] for h, s in states.items()}, "blocks": {h: s[1] for h, s in states.items() if s[1]}, "tripped": sorted(h for h, s in states.items() if s[3])}


def netloc(url: str) -> str:
    return urlparse(url).netloc

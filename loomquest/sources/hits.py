"""The Python data source "hits": spark.read.format("hits").option("query", ...).option("backends", "ddg,wiki").load().

A partition is a host, so hosts are asked in parallel and each of them one request at a time, under its gap, cap and breaker; a backend whose first address
gives nothing is asked at its second one by the task of that backend. Rows are raw answers (backend, body) with the host's counters after them;
parsed() turns them into hits. Options: query, backends, n, states (JSON from host to requests, blocks, gap and tripped of earlier loads, as host_states() gives
them, so that a run's loads share its limits), and transport (http, or fixture with answers as JSON from address to body)."""

from __future__ import annotations

import json
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomquest.sources import backends as B
from loomquest.sources.transport import Fixture, Http, asks_to_wait, netloc
from loomquest.streaming.breaker import HostState, Policy, jitter, signal


class Hits(DataSource):
    @classmethod
    def name(cls):
        return "hits"

    def schema(self):
        return "ord long, query string, backend_ord int, backend string, body string, host string, sent int, blocks int, gap double, tripped boolean"

    def reader(self, schema):
        return _Reader(self.options)


class _Hosts(InputPartition):
    """Backends whose hosts overlap, so that no host has two tasks: (place, name) of each."""

    def __init__(self, backends):
        self.backends = backends


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.query, self.n = options.get("query", ""), int(options.get("n", "6"))
        self.names = B.resolve([b for b in options.get("backends", "").split(",") if b])
        self.answers = json.loads(options["answers"]) if options.get("transport") == "fixture" else None
        self.states = json.loads(options.get("states", "{}"))
        self.settings = B.settings()

    def requests(self, name):
        return B.BACKENDS[name].requests(self.query, self.n, self.settings)

    def partitions(self):
        groups: list[tuple[set, list]] = []
        for place, name in enumerate(self.names):
            hosts, own = {netloc(r.url) for r in self.requests(name)}, [(place, name)]
            for g in [g for g in groups if g[0] & hosts]:
                groups.remove(g)
                hosts, own = hosts | g[0], g[1] + own
            groups.append((hosts, own))
        return [_Hosts(own) for _, own in groups]

    def read(self, partition):
        transport = Http() if self.answers is None else Fixture(self.answers)
        hosts: dict[str, HostState] = {}
        last: dict[str, float] = {}
        for place, name in partition.backends:
            for r in self.requests(name):
                host = netloc(r.url)
                s = hosts.setdefault(host, HostState(B.POLICIES.get(host, Policy()), *self.states.get(host, (0, 0, 0.0, False))))
                body = None
                if s.admit():
                    transport.sleep(max(0.0, s.gap - (time.monotonic() - last.get(host, -1e9))) + jitter(host))
                    status, body, error = transport.ask(r.url, r.method, r.form, r.headers)
                    last[host] = time.monotonic()
                    what = signal(status, error is not None, s.policy.ban_prone)
                    s.observe(what)
                    body = body if what == "ok" else None
                    if asks_to_wait(host, body):
                        s.observe("soft")
                full = B.BACKENDS[name].full(body)
                yield (0, self.query, place, name, body if full else None, host, s.requests, s.blocks, s.gap, s.tripped)
                if full:
                    break

"""Live fetching: requests wait in the state of a stream until their host may be asked again, and each record is on disk when its query's last answer is.

Requests lie as JSON in a folder, one a query and backend, with the addresses to be tried in turn. The stream deals them out by site (backends whose hosts overlap). The gate of a
site keeps its queue, and the counters and last request of each of its hosts; a processing-time timer wakes it when the gap of the host that is next is over, it sends that
one request, and sets the next timer. What it knows of a host lapses after TTL_SECONDS. All of that is state of the checkpoint: a stream that is started again goes on
with the queues, the counters and the gaps as they were. A request whose answer was not yet committed when a stream broke is sent again; one whose answer was is not.

The sink writes the answers of a batch into a folder of the batch's number, in place of what an earlier try left there, and hands the number on; so a batch that
runs twice leaves nothing twice."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from loomquest.sources import backends as B
from loomquest.sources.transport import asks_to_wait, netloc
from loomquest.streaming.breaker import HostState, Policy, jitter, signal

REQUEST = "site string, ord long, query string, backend_ord int, backend string, key string, tries string"
ANSWER = "ord long, query string, backend_ord int, backend string, key string, address string, body string, more int, host string, sent int, blocks int, gap double, tripped boolean"
_COLUMNS = [c.split()[0] for c in ANSWER.split(", ")]
TTL_SECONDS = 6 * 3600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMMARY = "https://en.wikipedia.org/api/rest_v1/page/summary/"


def _summaries(body: str, n: int) -> list[str]:
    """Where the summaries of an encyclopedia's hits are."""
    try:
        found = json.loads(body)["query"]["search"][:n]
        return [SUMMARY + quote(x["title"].replace(" ", "_"), safe="/") for x in found]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []


class Gate(StatefulProcessor):
    """One site's queue and hosts. Requests go out in the order in which they came, one for each time the gate wakes; the summaries of a page of hits come next after it."""

    def __init__(self, transport, policies: dict[str, Policy], before: dict[str, tuple], n: int, clock: Callable[[], float] = time.time):
        self.transport, self.policies, self.before, self.n, self.clock = transport, policies, before, n, clock

    def init(self, handle):
        self.handle = handle
        self.queue = handle.getMapState("queue", "place long", "request string")
        self.ends = handle.getValueState("ends", "head long, tail long")
        self.hosts = handle.getMapState("hosts", "host string", "requests int, blocks int, gap double, tripped boolean, last double", ttlDurationMs=TTL_SECONDS * 1000)

    def _bounds(self) -> tuple[int, int]:
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0)

    def _host(self, host: str) -> tuple[HostState, float]:
        held = self.hosts.getValue((host,)) if self.hosts.containsKey((host,)) else None
        if held is not None:
            return HostState(self.policies.get(host, Policy()), *held[:4]), held[4]
        return HostState(self.policies.get(host, Policy()), *self.before.get(host, (0, 0, 0.0, False))), 0.0

    def handleInputRows(self, key, rows, timerValues):
        head, tail = self._bounds()
        waiting = tail > head
        for frame in rows:
            for r in frame.sort_values(["ord", "backend_ord"]).itertuples():
                own = {"ord": int(r.ord), "query": r.query, "backend_ord": int(r.backend_ord), "backend": r.backend, "key": r.key, "tries": [json.loads(t) for t in json.loads(r.tries)]}
                self.queue.updateValue((tail,), (json.dumps(own),))
                tail += 1
        self.ends.update((head, tail))
        if not waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs())
        return iter([])

    def _next(self, head: int, tail: int):
        """Wakes the gate when the host of the first request may be asked."""
        if head < tail:
            host = netloc(json.loads(self.queue.getValue((head,))[0])["tries"][0]["url"])
            state, last = self._host(host)
            self.handle.registerTimer(int(1000 * (self.clock() if state.tripped else max(self.clock(), last + state.gap + jitter(host)))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        head, tail = self._bounds()
        if head == tail:
            return
        own = json.loads(self.queue.getValue((head,))[0])
        self.queue.removeKey((head,))
        head += 1
        at, more = own["tries"][0], []
        host, body = netloc(at["url"]), None
        state, last = self._host(host)
        if state.admit():
            last = self.clock()
            status, body, error = self.transport.ask(at["url"], at["method"], at["form"], tuple(at["headers"].items()))
            what = signal(status, error is not None, state.policy.ban_prone)
            state.observe(what)
            body = body if what == "ok" else None
            if asks_to_wait(host, body):
                state.observe("soft")
        self.hosts.updateValue((host,), (state.requests, state.blocks, state.gap, state.tripped, last))
        told = (host, state.requests, state.blocks, state.gap, state.tripped)
        summary = own.get("summary", False)
        full = summary or B.BACKENDS[own["backend"]].full(body)
        if not full and len(own["tries"]) > 1:
            more = [own | {"tries": own["tries"][1:]}]
            row = (own["ord"], own["query"], own["backend_ord"], None, None, at["url"], None, 0, *told)  # no answer yet, only what the host's counters are now
        else:
            if own["backend"] == "wiki" and not summary and body:
                more = [own | {"summary": True, "tries": [{"url": u, "method": "GET", "form": "", "headers": {}}]} for u in _summaries(body, self.n)]
            name = f"{own['backend']}:summary" if summary else own["backend"]
            row = (own["ord"], own["query"], own["backend_ord"], name, None if summary else own["key"], at["url"], body if full else None, 0 if summary else len(more), *told)
        for m in reversed(more):
            head -= 1
            self.queue.updateValue((head,), (json.dumps(m),))
        self.ends.update((head, tail))
        self._next(head, tail)
        yield pd.DataFrame([row], columns=_COLUMNS)

    def close(self):
        pass


def sites(names: list[str], addresses: dict[str, set[str]]) -> dict[str, str]:
    """A site for each backend: those whose hosts overlap have one, so that no host has two gates. addresses: the hosts of each backend."""
    groups: list[tuple[set, list]] = []
    for name in names:
        hosts, own = set(addresses[name]), [name]
        for g in [g for g in groups if g[0] & hosts]:
            groups.remove(g)
            hosts, own = hosts | g[0], g[1] + own
        groups.append((hosts, own))
    return {name: min(hosts) for hosts, own in groups for name in own}


def session(spark: SparkSession, tasks: int) -> SparkSession:
    """A session beside the given one whose streams keep their state in RocksDB, in as many parts as there are sites; the given one's settings stay as they are."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.shuffle.partitions", str(max(1, tasks)))
    beside.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    beside.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    return beside


def answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER + ", batch long").parquet(path)


def run(spark: SparkSession, folder: str, gate: Gate, tasks: int, told: Callable[[int], bool], every: str = "200 milliseconds") -> None:
    """Runs the stream over folder/requests until told(batch) says that all is done. folder/answers/batch=N is written before told(N) is called, in the stream's thread; what it
    raises ends the stream and is raised here. folder/checkpoint is what a later call goes on from."""
    over = []

    def sink(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()  # the answers of one batch, at most one a site: a gate must not be asked for them twice
        try:
            if not rows.isEmpty():
                rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/answers/batch={batch}")
                if told(batch):
                    over.append(batch)
        finally:
            rows.unpersist()

    stream = session(spark, tasks).readStream.schema(REQUEST).json(f"{folder}/requests")
    fetched = stream.groupBy("site").transformWithStateInPandas(gate, ANSWER, "append", "processingTime")
    running = fetched.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
    try:
        while not over and not running.awaitTermination(0.2):
            pass
    finally:
        running.stop()

"""Per-host politeness as data: a replay of a request log by windows, and the same machine as a stateful streaming query.

A log has host, ts and signal (ok, soft, hard or error). Live fetching uses HostState, one per host and task."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

BLOCKS_TO_TRIP, MAX_GAP = 3, 30.0
#: What a host's log is cut into.
SPAN = "hour"


@dataclass(frozen=True)
class Policy:
    """How a host is to be treated."""

    gap: float = 1.5
    cap: int = 300
    ban_prone: bool = False


def jitter(host: str) -> float:
    """Seconds added to every wait, fixed per host."""
    return int(hashlib.md5(host.encode()).hexdigest(), 16) % 400 / 1000


def signal(status: int | None, failed: bool, ban_prone: bool) -> str:
    """What an outcome says: error (no answer at all), ok, soft (a friendly host asks to slow down) or hard."""
    if failed and status is None:
        return "error"
    if failed:
        return "soft" if status in (429, 503) and not ban_prone else "hard"
    return "hard" if status == 202 or status >= 400 else "ok"


def signals(status: Column, failed: Column, ban_prone: Column) -> Column:
    """signal() of columns; without a status, what did not fail is ok."""
    busy = status.isin(429, 503) & ~ban_prone
    return F.when(failed & status.isNull(), "error").when(failed, F.when(busy, "soft").otherwise("hard")).when((status == 202) | (status >= 400), "hard").otherwise("ok")


@dataclass
class HostState:
    """One host's requests, blocks and gap in a run; once tripped, nothing more is sent."""

    policy: Policy = field(default_factory=Policy)
    requests: int = 0
    blocks: int = 0
    gap: float = 0.0
    tripped: bool = False

    def __post_init__(self):
        self.gap = self.gap or self.policy.gap

    def admit(self) -> bool:
        """Whether one more request may go; the one over the cap trips the host."""
        if not self.tripped and self.requests >= self.policy.cap:
            self.tripped = True
        if self.tripped:
            return False
        self.requests += 1
        return True

    def observe(self, what: str) -> None:
        if what in ("soft", "hard"):
            self.blocks += 1
            if what == "soft":
                self.gap = min(2 * self.gap, MAX_GAP)
            self.tripped = self.tripped or self.blocks >= BLOCKS_TO_TRIP or (what == "hard" and self.policy.ban_prone)


def replay(log: DataFrame, cap: int, order: list[str], blocks: int = BLOCKS_TO_TRIP) -> DataFrame:
    """log: host, signal, and the columns of order, of which the first is the time. Adds seq (request number of the host), blocks_before and admitted: within the cap and
    before the block that trips the host. On a fixed log this marks what the live machine would have let through.

    A busy host's rows are not one task's: counts by host and span of time are summed up over the spans, and only the rows of a span are sorted together."""
    block = F.col("signal").isin("soft", "hard").cast("long")
    d = log.withColumn("__span", _span(order))
    spans = d.groupBy("host", "__span").agg(F.count("*").alias("__n"), F.sum(block).alias("__b"))
    earlier = W.partitionBy("host").orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("host", "__span", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__n", "__b")])
    w = W.partitionBy("host", "__span").orderBy(*order)
    d = d.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("blocks_before", F.coalesce(F.sum(block).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = _with_spans(d, spans).withColumns({"seq": F.col("seq") + F.col("__n_before"), "blocks_before": F.col("blocks_before") + F.col("__b_before")})
    return d.withColumn("admitted", (F.col("seq") <= cap) & (F.col("blocks_before") < blocks)).drop("__n_before", "__b_before")


def _span(order: list[str]) -> Column:
    """The span of time that a row falls into, short enough for one task even where a host is busy."""
    return F.date_trunc(SPAN, F.col(order[0]).cast("timestamp"))


def _with_spans(d: DataFrame, spans: DataFrame) -> DataFrame:
    host, span = d["host"].eqNullSafe(spans["host"]), d["__span"].eqNullSafe(spans["__span"])
    return d.join(spans, host & span).drop(spans["host"]).drop(spans["__span"]).drop("__span")


def waits(log: DataFrame, gap: float, order: list[str]) -> DataFrame:
    """Adds wait_s: how long a request would have to wait so that gap seconds lie between it and the host's last one. order begins with ts; rows are sorted by spans, as
    replay() does."""
    d = log.withColumn("__span", _span(order))
    spans = d.groupBy("host", "__span").agg(F.max("ts").alias("__ts"))
    spans = spans.select("host", "__span", F.lag("__ts").over(W.partitionBy("host").orderBy("__span")).alias("__last"))
    d = d.withColumn("__before", F.lag("ts").over(W.partitionBy("host", "__span").orderBy(*order)))
    d = _with_spans(d, spans)
    before = F.coalesce("__before", "__last")
    since = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    return d.withColumn("wait_s", F.when(since.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(gap) - since))).drop("__before", "__last")


_STATE = "requests int, blocks int, gap double, tripped boolean"


def guarded(stream: DataFrame, policies: dict[str, Policy] | None = None, default: Policy | None = None) -> DataFrame:
    """The machine over a stream of host, seq, signal: each row with admitted, requests and blocks. State is four numbers a host, kept by the
    checkpoint, so a restart goes on where it stopped. Rows of one micro-batch are taken in order of seq."""
    known, usual = policies or {}, default or Policy()

    def run(key, frames, state: GroupState):
        host = HostState(known.get(key[0], usual), *(state.get if state.exists else (0, 0, 0.0, False)))
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            let = host.admit()
            if let:
                host.observe(row.signal)
            out.append((key[0], int(row.seq), let, host.requests, host.blocks))
        state.update((host.requests, host.blocks, host.gap, host.tripped))
        yield pd.DataFrame(out, columns=["host", "seq", "admitted", "requests", "blocks"])

    return stream.groupBy("host").applyInPandasWithState(run, "host string, seq long, admitted boolean, requests int, blocks int", _STATE, "append", GroupStateTimeout.NoTimeout)

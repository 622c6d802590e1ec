"""Sharding by histogram sort: splitters are refined from exact byte counts until each meets its tolerance, then rows are exchanged once.

The sort key is 64 bits: the high bits hash the text, so equal texts stand together, and the low bits hash the doc_id, so a large
group of equal texts can be cut. Every round counts the bytes below all open probes in one pass over a narrow table."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomquest.llm.common import discard, saved

SHARDS = 24
ROW_BYTES = 8
#: Share of a shard's even size by which a splitter may miss.
TOLERANCE = 0.001
#: Cells are the unit of the exchange; a shard is a run of them. So many a shard at least, more where cells would pass so many rows.
CELLS, CELL_ROWS = 9, 1_000_000
PROBES = 24
LOW_BITS = 24


def _histogram(probes: list[int]):
    """Rows and bytes between probes, one row per cell and partition."""
    edges = np.array(probes, np.int64)

    def count(batches):
        total = np.zeros((2, len(edges) + 1), np.int64)
        for b in batches:
            cell = np.searchsorted(edges, b.column(0).to_numpy(), side="right")
            total[0] += np.bincount(cell, minlength=len(edges) + 1)
            np.add.at(total[1], cell, b.column(1).to_numpy())
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0][at]), pa.array(total[1][at])], names=["cell", "n", "bytes"])

    return count


def splitters(keyed: DataFrame, goals: list[int], slack: list[int], probes: int = PROBES, bounds: tuple[int, int] = (-(2**63), 2**63 - 1)) -> tuple[list[int], list[int], list[int]]:
    """keyed: key, size (both long, not null). For each goal, a key with about that many bytes below it (keys < splitter), off by slack
    at most, or as near as whole keys allow. Returns splitters, and rows and bytes below each.

    Each round brings one row per probe to the driver, so it is bounded by the number of splitters."""
    first, last = bounds
    low, high = [first] * len(goals), [last] * len(goals)
    best: list[tuple[int, int, int, int] | None] = [None] * len(goals)  # miss, key, rows, bytes
    for turn in range(70):
        asked: set[int] = set()
        for i, (a, b) in enumerate(zip(low, high, strict=True)):
            if a < b and (best[i] is None or best[i][0] > slack[i]):
                if turn == 0:
                    # with even keys, the goal's place in the key range is a good first guess
                    mid = first + (last - first) * (i + 1) // (len(goals) + 1)
                    width = (last - first) // (4 * (len(goals) + 1)) + 1
                    asked |= {min(last, max(first, mid + width * j // 4)) for j in range(-8, 9)} | {last}
                else:
                    asked |= {a + (b - a) * j // (probes + 1) for j in range(1, probes + 1)} | {b}
        if not asked:
            break
        edges = sorted(asked)
        counts = keyed.select("key", "size").mapInArrow(_histogram(edges), "cell long, n long, bytes long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()
        n, size = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for r in counts:
            n[r["cell"]], size[r["cell"]] = r["n"], r["bytes"]
        n, size = np.cumsum(n)[:-1], np.cumsum(size)[:-1]  # below each edge
        place = np.searchsorted(size, np.array(goals), side="left").tolist()  # the first edge with the goal below it
        for i, j in enumerate(place):
            for k in (j - 1, j):
                if 0 <= k < len(edges) and (best[i] is None or abs(int(size[k]) - goals[i]) < best[i][0]):
                    best[i] = (abs(int(size[k]) - goals[i]), edges[k], int(n[k]), int(size[k]))
            if j > 0:
                low[i] = max(low[i], edges[j - 1] + 1)
            if j < len(edges):
                high[i] = min(high[i], edges[j])
    return [b[1] for b in best], [b[2] for b in best], [b[3] for b in best]


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", tolerance: float = TOLERANCE, cells: int = CELLS) -> DataFrame:
    """Columns of docs plus size (UTF-8 bytes of the text plus 8; null: 8), shard and slot (0, 1, ... in
    each shard, in key order). Shards are near equal in size: splitters miss their goal by tolerance of a shard, or by half of the
    rows that share a key. Equal texts stand together, cut only where a splitter falls among them.

    Null texts share the key of the empty text. Rows with a null doc_id are placed like others, long texts whole. Rows of one key and doc_id stand in the order of a hash
    of all their columns, and equal rows share their slots in any order. An empty table gives no rows. Columns size, shard and slot of the input are replaced."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    # The low bits never reach the sign; null ids hash like any value.
    high, low = F.lit(~((1 << LOW_BITS) - 1)).cast("long"), F.lit((1 << LOW_BITS) - 1).cast("long")
    key = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(high).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(low))
    tie = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    d = docs.withColumn("__tie", tie).drop("size", "shard", "slot", "__key").withColumns({"size": size, "__key": key})
    narrow = saved(d.select(F.col("__key").alias("key"), "size"), "keys")
    total = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    edges: dict[int, int] = {}  # key: rows below it
    borders: list[int] = []
    if total["n"]:
        even = total["b"] / shards
        borders, rows, _ = splitters(narrow, [total["b"] * i // shards for i in range(1, shards)], [int(tolerance * even)] * (shards - 1))
        edges |= zip(borders, rows, strict=True)
        # Cells, by bytes and rows alike, so that neither long texts nor many empty ones fill one.
        count, mean = max(shards * cells, -(-2 * total["n"] // CELL_ROWS)), -(-total["b"] // total["n"])
        whole = total["b"] + mean * total["n"]
        keys, rows, _ = splitters(narrow.select("key", (F.col("size") + mean).alias("size")), [whole * i // count for i in range(1, count)], [whole // count // 8] * (count - 1))
        edges |= zip(keys, rows, strict=True)
    discard(narrow)
    keys = sorted(edges)
    shard_of = np.searchsorted(np.sort(borders), [-(2**63), *keys], side="right")
    # slot = place in the cell + rows of the shard's cells before it
    first = [0, *(edges[k] for k in keys)]
    start = [first[int(np.argmax(shard_of == s))] for s in shard_of]
    return _placed(d, keys, shard_of, np.array(first) - np.array(start))


def _placed(d: DataFrame, keys: list[int], shard_of: np.ndarray, before: np.ndarray) -> DataFrame:
    edges = np.array(keys, np.int64)

    @F.pandas_udf("int")
    def cell_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("int")
    def shard(cell: pd.Series) -> pd.Series:
        return pd.Series(shard_of[cell.to_numpy()].astype(np.int32))

    @F.pandas_udf("long")
    def before_of(cell: pd.Series) -> pd.Series:
        return pd.Series(before[cell.to_numpy()])

    d = d.withColumn("__cell", cell_of("__key")).repartitionById(len(keys) + 1, F.col("__cell"))
    order = W.partitionBy("__cell").orderBy("__key", F.col("doc_id"), "__tie")
    d = d.withColumn("__in", F.row_number().over(order) - 1)
    return d.withColumns({"slot": before_of("__cell") + F.col("__in"), "shard": shard("__cell")}).drop("__cell", "__key", "__in", "__tie")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """One folder per shard, shard=k, with rows in slot order within each file."""
    sharded(docs, **how).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

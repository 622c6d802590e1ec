"""Substring dedup with fixed-block anchors.

The non-overlapping blocks of BLOCK words of every document are the index; every rolling window of BLOCK words of every document probes it. Any
repeat of WINDOW = 2 * BLOCK words holds a whole block of the document that it repeats, so a document's hits say where repeats can be.
Each hit is then extended word by word as far as windows of WINDOW words around it also start in a document with a smaller id: those windows are compared with those of
other documents, and what they cover together are the maximal exact repeats that are removed. Anchors are compared by 64 bits at most, since a wrong one only costs a
window's comparison; windows are compared by 128 bits, two polynomials in the words' hashes, before a word goes.

Both exchanges move packed binary rows, one for each batch of documents and range of hashes. A batch first merges what it has of one hash, so a
passage in any number of documents comes to one record for each batch that holds it; no pair of documents is ever made. What a range
finds goes back to the batch by its number, where the list of its documents turns places into documents. A batch makes FAN rows at most: where there are more
ranges, a first exchange deals the records to FAN groups of ranges, which gather them into rows of many batches and deal those to the ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import saved, words

WINDOW = 50
#: Words in a batch of documents, and bytes of text (of the whole input) for each range of hashes.
FLUSH, RANGE_BYTES = 1_000_000, 16 << 20
#: Rows that a batch makes for an exchange, at most, and records that a group of ranges gathers before it deals them out.
FAN, GATHER = 4096, 2_000_000
#: Places found are broadcast to their documents up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20
NO_ID = 2**63 - 1
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the two polynomials.
_TIMES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EXCHANGE = "batch long, kind int, part int, n int, blob binary"
RECORDS, PLACES, NAMES, GATHERED = 0, 1, 2, 3


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _rolled(values: np.ndarray, size: int, which: int) -> np.ndarray:
    """A polynomial in the word hashes of every run of size words, mixed."""
    n = max(0, len(values) - size + 1)
    out, v = np.zeros(n, np.uint64), _mixed(values.view(np.uint64) ^ _TIMES[1 - which])
    for k in range(size if n else 0):
        out *= _TIMES[which]
        out += v[k : k + n]
    return _mixed(out)


def _inside(counts: np.ndarray, size: int) -> np.ndarray:
    """Places where runs of size words start that lie inside one document."""
    total = int(counts.sum())
    n = max(0, total - size + 1)
    ends = np.repeat(np.cumsum(counts), counts)[:n]
    return np.flatnonzero(np.arange(size, size + n) <= ends)


def _gathered(batches):
    """(number of the batch, columns): documents up to FLUSH words. Columns: doc, row, word hashes of all, words of each, then Arrow arrays."""
    from pyspark import TaskContext

    number, held, n = TaskContext.get().partitionId() << 32, [], 0

    def whole():
        return [np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(*held, strict=True)]

    for b in batches:
        lists = b.column(2)
        off = lists.offsets.to_numpy()
        flat, at = lists.values.to_numpy(zero_copy_only=False), 0
        while at < b.num_rows:  # an Arrow batch can hold many times FLUSH
            to = max(at + 1, int(np.searchsorted(off, off[at] + FLUSH - n, side="right")) - 1)
            held.append((b.column(0)[at:to].to_numpy(), b.column(1)[at:to].to_numpy(), flat[off[at] : off[to]], np.diff(off[at : to + 1]).astype(np.int64), *[c[at:to] for c in b.columns[3:]]))
            n += int(off[to] - off[at])
            at = to
            if n >= FLUSH or at < b.num_rows:
                yield number, whole()
                number, held, n = number + 1, [], 0
    if held:
        yield number, whole()


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """By the 32 highest bits: even ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _low(hashes: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _hashes(blob: bytes, n: int, size: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :size] = np.frombuffer(blob, np.uint8, size * n).reshape(n, size)
    return raw.view("<u8").ravel()


def _records(number: int, parts: int, hashes: np.ndarray, columns: list[np.ndarray], size: int, place: np.ndarray, flag: np.ndarray):
    """One exchange row per range: the low bytes of the hashes, place (in steps of two bytes, with flag in the lowest bit), columns."""
    part = _range_of(hashes, parts)
    order = np.lexsort((place, part))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[p] : bounds[p + 1]]
        step = np.diff(place[own], prepend=0)
        kind = "<u2" if step.max() < 1 << 15 else "<u4"
        blob = b"".join([kind[2:].encode(), _low(hashes[own], size), (step << 1 | flag[own]).astype(kind).tobytes(), *[c[own].tobytes() for c in columns]])
        rows.append((number, RECORDS, int(p), len(own), blob))
    return rows


def _places(number: int, place: np.ndarray, parts: int):
    return (number, PLACES, number % parts, len(place), np.unique(place).astype("<i4").tobytes())


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["batch", "kind", "part", "n", "blob"])


def _names(number: int, parts: int, doc: np.ndarray, row: np.ndarray, counts: np.ndarray):
    return (number, NAMES, number % parts, len(doc), doc.astype("<i8").tobytes() + row.astype("<i8").tobytes() + counts.astype("<i4").tobytes())


def _groups(*hashes: np.ndarray):
    """Order by hashes, starts and sizes of the runs in which all of them are equal."""
    order = np.lexsort(hashes) if len(hashes) > 1 else np.argsort(hashes[0], kind="stable")
    change = np.zeros(len(order), bool)
    for h in hashes:
        change[1:] |= h[order][1:] != h[order][:-1]
    change[:1] = True
    first = np.flatnonzero(change)
    return order, first, np.diff(np.append(first, len(order)))


def _probe(parts: int, block: int, low: int):
    """A batch's part of the anchor exchange: one record per hash, flagged where some window of that hash is a block of the index. What
    the batch holds more than once may be a repeat without asking anybody."""

    def run(batches):
        for number, (doc, row, values, counts) in _gathered(batches):
            place = _inside(counts, block)
            h = _rolled(values, block, 0)[place]
            rows = [_names(number, parts, doc, row, counts)]
            if len(h):
                begin = np.repeat(np.cumsum(counts) - counts, counts)
                indexed = (place - begin[place]) % block == 0
                order, first, size = _groups(h)
                one = order[first]
                rows += _records(number, parts, h[one], [], low, place[one], np.logical_or.reduceat(indexed[order], first))
                rows.append(_places(number, place[order[np.repeat(size > 1, size)]], parts))
            yield _table(rows)

    return run


def _opened(number: int, n: int, blob: bytes, size: int, kinds: list[str]) -> tuple:
    """Batch numbers, places, flags, hashes and columns of a row of records."""
    step, at_byte = f"<u{blob[:1].decode()}", 1 + size * n
    moved = np.frombuffer(blob, step, n, at_byte).astype(np.int64)
    at_byte += n * np.dtype(step).itemsize
    columns = []
    for k in kinds:
        columns.append(np.frombuffer(blob, k, n, at_byte))
        at_byte += n * np.dtype(k).itemsize
    return np.full(n, number), np.cumsum(moved >> 1), moved & 1, _hashes(blob[1:], n, size), *columns


def _ungathered(n: int, blob: bytes, kinds: list[str]) -> tuple:
    out, at = [], 0
    for k in ("<i8", "<i4", "u1", "<u8", *kinds):
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out[0], out[1].astype(np.int64), out[2].astype(np.int64), out[3], *out[4:]


def _dealt_on(parts: int, kinds: list[str]):
    """Of a group of ranges: rows of few records of a batch become rows of many, one a range."""

    def dealt(held):
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        part = _range_of(columns[3], parts)
        order = np.argsort(part, kind="stable")
        ranges, start = np.unique(part[order], return_index=True)
        rows = []
        for p, a, b in zip(ranges.tolist(), start, [*start[1:], len(order)], strict=True):
            own = order[a:b]
            blob = b"".join(c[own].astype(k).tobytes() for c, k in zip(columns, ("<i8", "<i4", "u1", "<u8", *kinds), strict=True))
            rows.append((0, GATHERED, p, len(own), blob))
        return _table(rows)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for number, kind, part, count, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind != RECORDS:
                    yield _table([(number, kind, part, count, blob)])
                    continue
                held.append(_opened(number, count, blob, 8, kinds))
                n += count
                if n >= GATHER:
                    yield dealt(held)
                    held, n = [], 0
        if held:
            yield dealt(held)

    return run


def _by_range(batches, size: int, kinds: list[str]):
    """Yields ("pass", rows) for rows that are not records, and at each range's end ("range", batch numbers, places, flags, hashes, columns)."""
    held, at = [], None

    def done():
        return "range", *[np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        for number, kind, part, n, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if part != at and held:
                yield done()
                held = []
            at = part
            if kind not in (RECORDS, GATHERED):
                yield "pass", (number, kind, part, n, blob)
                continue
            held.append(_opened(number, n, blob, size, kinds) if kind == RECORDS else _ungathered(n, blob, kinds))
    if held:
        yield done()


def _answers(number: np.ndarray, place: np.ndarray):
    """Exchange rows of places, by batch."""
    order = np.lexsort((place, number))
    number, place = number[order], place[order].astype("<i4")
    start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
    return [(int(number[a]), PLACES, 0, int(b - a), place[a:b].tobytes()) for a, b in zip(start, [*start[1:], len(number)], strict=True)] if len(number) else []


def _matched(low: int):
    """The index side: windows whose hash some other batch has too are hits, if one of them is an indexed block."""

    def run(batches):
        for what, *rest in _by_range(batches, low, []):
            if what == "pass":
                yield _table(rest)
                continue
            number, place, flag, h = rest
            order, first, size = _groups(h)
            hit = order[np.repeat((size > 1) & np.logical_or.reduceat(flag[order] > 0, first), size)]
            if rows := _answers(number[hit], place[hit]):
                yield _table(rows)

    return run


def _extended(parts: int, window: int):
    """A batch's part of the window exchange: every window that holds a hit, the least document of each hash going on."""

    def run(batches):
        for number, (doc, row, values, counts, hits) in _gathered(batches):
            rows, place = [_names(number, parts, doc, row, counts)], _inside(counts, window)
            begin = np.cumsum(counts) - counts
            # the spans hold the places where windows that hold a hit start
            spans = np.concatenate([b + np.frombuffer(x, "<i4").astype(np.int64) for b, x in zip(begin, hits.to_pylist(), strict=True)]).reshape(-1, 2)
            mark = np.zeros(len(values) + 1, np.int32)
            np.add.at(mark, spans[:, 0], 1)
            np.add.at(mark, np.minimum(spans[:, 1], len(values)), -1)
            place = place[np.cumsum(mark)[place] > 0]
            if len(place):
                h, check = (_rolled(values, window, k)[place] for k in (0, 1))
                who = np.repeat(doc, counts)[place]
                order, first, size = _groups(check, h)
                least = np.repeat(np.minimum.reduceat(who[order], first), size)
                mine = who[order]
                rows.append(_places(number, place[order[mine > least]], parts))
                own = order[mine == least]
                rows += _records(number, parts, h[own], [who[own].astype("<i8"), check[own]], 8, place[own], np.zeros(len(own), np.int64))
            yield _table(rows)

    return run


def _judged(batches):
    """Of each window, the documents that are not the least one that holds it."""
    for what, *rest in _by_range(batches, 8, ["<i8", "<u8"]):
        if what == "pass":
            yield _table(rest)
            continue
        number, place, _, h, doc, check = rest
        order, first, size = _groups(check, h)
        late = order[doc[order] > np.repeat(np.minimum.reduceat(doc[order], first), size)]
        if rows := _answers(number[late], place[late]):
            yield _table(rows)


def _named(before: int, after: int):
    """Turns a batch's places into spans of its documents: doc, row, and the merged spans from before a place to after it, as int32 pairs start, end."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"doc": [], "row": [], "found": []}
        names = rows[rows.kind == NAMES]
        found = [np.frombuffer(x, "<i4") for x in rows[rows.kind == PLACES].blob]
        place = np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
        if len(names) and len(place):
            n, blob = int(names.n.iloc[0]), names.blob.iloc[0]
            doc, row, counts = np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<i8", n, 8 * n), np.frombuffer(blob, "<i4", n, 16 * n).astype(np.int64)
            ends = np.cumsum(counts)
            who = np.searchsorted(ends, place, side="right")
            start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            for a, b in zip(start, [*start[1:], len(who)], strict=True):
                w = who[a]
                p = place[a:b] - (ends[w] - counts[w])
                cut = np.flatnonzero(np.concatenate([[True], p[1:] - before > p[:-1] + after]))
                pairs = np.stack([np.maximum(p[cut] - before, 0), p[np.append(cut[1:], len(p)) - 1] + after], axis=1)
                out["doc"].append(doc[w])
                out["row"].append(row[w])
                out["found"].append(pairs.astype("<i4").tobytes())
        return pd.DataFrame(out).astype({"doc": "int64", "row": "int64", "found": object})

    return run


def _exchanged(made: DataFrame, parts: int, kinds: list[str], judge, around: tuple[int, int], name: str) -> DataFrame:
    """The way of either exchange: records to their range, answers back to their batch, names to places. Written to the shared folder."""
    if parts > FAN:
        made = made.repartitionById(FAN, F.col("part")).mapInArrow(_dealt_on(parts, kinds), _EXCHANGE)
    ranged = made.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(judge, _EXCHANGE)
    return saved(ranged.groupBy("batch").applyInPandas(_named(*around), "doc long, row long, found binary"), name)


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs with what was found in them, by (doc, row)."""
    size = found.agg(F.coalesce(F.sum(F.octet_length("found") + 40), F.lit(0))).first()[0]
    return docs.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["doc", "row"], how)


def removed_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """doc (NO_ID for null), row (a hash of the text), found: merged spans of words to remove, int32 pairs start, end. Only documents that have some."""
    spark, block = docs.sparkSession, window // 2
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    parts = parts if parts <= FAN else -(-parts // FAN) * FAN  # whole groups of ranges
    dealt, low = min(parts, FAN), 5 if parts <= FAN else 8
    hits = _exchanged(keyed.select("doc", "row", hashes).mapInArrow(_probe(dealt, block, low), _EXCHANGE), parts, [], _matched(low), (window - block, 1), "hits")
    hits = hits.dropDuplicates(["doc", "row"])  # rows that repeat another whole row are one
    near = _joined(keyed, hits, "inner").select("doc", "row", hashes, "found")
    return _exchanged(near.mapInArrow(_extended(dealt, window), _EXCHANGE), parts, ["<i8", "<u8"], _judged, (0, window), "spans").dropDuplicates(["doc", "row"])


def deduped(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns of docs plus n_words, n_removed (long) and kept (the words left, joined by single spaces).

    Each word covered by a window of so many words whose sequence also starts in a document with a smaller doc_id goes; windows are judged
    on the input. Null, empty and short texts lose nothing; long texts are taken whole; null ids count as larger than all others; rows with equal ids never take words
    from each other, and rows that repeat a whole row are treated alike. An empty table gives an empty one. Columns doc, row, kept_from and kept_to of the input go."""
    found = removed_spans(docs, text, window)
    spans = found.mapInPandas(_spans_as_arrays, "doc long, row long, kept_from array<int>, kept_to array<int>, n_removed long")
    d = docs.drop("n_words", "n_removed", "kept").withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "row": F.xxhash64(text)})
    size = found.agg(F.coalesce(F.sum(F.octet_length("found") + 40), F.lit(0))).first()[0]
    d = d.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["doc", "row"], "left").withColumn("__w", words(F.col(text)))
    # Runs of kept words between the removed spans; the last one ends with the text.
    runs = F.transform(F.arrays_zip("kept_from", "kept_to"), lambda x: F.slice("__w", x["kept_from"] + 1, F.least(x["kept_to"], F.size("__w")) - x["kept_from"]))
    kept = F.when(F.col("kept_from").isNull(), F.col("__w")).otherwise(F.flatten(runs))
    out = d.withColumns({"n_words": F.size("__w").cast("long"), "n_removed": F.coalesce("n_removed", F.lit(0)).cast("long"), "kept": F.array_join(kept, " ")})
    return out.drop("doc", "row", "__w", "kept_from", "kept_to")


def _spans_as_arrays(frames):
    for f in frames:
        starts, ends, gone = [], [], []
        for x in f.found:
            pairs = np.frombuffer(x, "<i4").reshape(-1, 2)
            starts.append(np.concatenate([[0], pairs[:, 1]]).astype(np.int32))
            ends.append(np.concatenate([pairs[:, 0], [2**31 - 1]]).astype(np.int32))
            gone.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
        yield pd.DataFrame({"doc": f.doc, "row": f.row, "kept_from": starts, "kept_to": ends, "n_removed": gone})

"""Periodic runs of words, after Kolpakov and Kucherov.

A run is a maximal stretch of period q, at least max(LEAST, 2 * q) words long. The Lempel-Ziv factors of a stretch come from its suffix automaton, whose states know where they
first end. Main's algorithm finds the runs that touch the border between two factors, by longest common extensions on both sides of it. All other runs lie strictly inside a factor
and are copied from the factor's earlier occurrence.

Not all words need an automaton. A word of a run stands in a sequence of SEED words that comes again q words before or after, inside the same run; so runs lie
wholly in stretches of words that such repeated sequences cover, and are maximal in the document when they are in their stretch. Stretches are found for many documents at once by hashes (equal
hashes of unequal sequences only make a stretch longer), again inside the stretches until they shrink no more, and the search runs on what is left."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import words

#: The least length of a run. A run of period q <= LEAST - SEED has SEED words that recur q later; a longer period, q words that do.
LEAST = 12
SEED = LEAST // 2
#: Words in a batch of documents, about.
FLUSH = 1_000_000
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors (begin, end, begin of an earlier occurrence, which may overlap, or -1 for a word that is new)."""
    # The automaton: most states have one way on, kept in two arrays; the others of a state are in a dictionary.
    word, to, more = array("q", [-1]), array("q", [-1]), {}
    link, size, ends = array("q", [-1]), array("q", [0]), array("q", [-1])
    last = 0
    for i, c in enumerate(w):
        new = len(size)
        word.append(-1), to.append(-1), link.append(0), size.append(i + 1), ends.append(i)
        p = last
        while p >= 0:
            if word[p] < 0:
                word[p], to[p] = c, new
            elif word[p] == c:
                q = to[p]
                break
            else:
                ways = more.setdefault(p, {})
                if c in ways:
                    q = ways[c]
                    break
                ways[c] = new
            p = link[p]
        if p >= 0:
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(size)
                word.append(word[q]), to.append(to[q]), link.append(link[q]), size.append(size[p] + 1), ends.append(ends[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if word[p] == c:
                        if to[p] != q:
                            break
                        to[p] = twin
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = twin
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, b = [], 0
    while b < len(w):
        at, e = 0, b
        while e < len(w):
            c = w[e]
            on = to[at] if word[at] == c else more[at][c]
            if ends[on] >= e:  # its first occurrence is this one
                break
            at, e = on, e + 1
        out.append((b, e, ends[at] - (e - b) + 1) if e > b else (b, b + 1, -1))
        b = max(e, b + 1)
    return out


def _common(head: list[int], text: list[int]) -> list[int]:
    """For each place of text, how many words from there on are those that head begins with."""
    n, both = len(head), [*head, -1, *text]
    z, left, right = [0] * len(both), 0, 0
    for i in range(1, len(both)):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < len(both) and both[k] == both[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z[n + 1 :]


def _touching(w: list[int], a: int, b: int, c: int):
    """Repetitions (start, end, period) of at least LEAST words in w[a:c] that touch b and cannot be extended in w."""
    t, u, n = w[a:b], w[b:c], len(w)
    back, whole = t[::-1], w[a:c]
    # How far the words before b agree with those before b + p and before b - p, and the words from b on with those from b + p and b - p on.
    before_right = _common(back, whole[::-1])[::-1]
    before_left = _common(back, back) if t else []
    after_right = _common(u, u) if u else []
    after_left = _common(u, whole)
    found = []
    for p in range(1, len(u) + 1):
        x, y = before_right[len(t) + p - 1], after_right[p] if p < len(u) else 0
        if x + y >= p and x + y + p >= LEAST:
            found.append((b - x, b + p + y, p))
    for p in range(1, len(t) + 1):
        x, y = before_left[p] if p < len(t) else 0, after_left[len(t) - p]
        if x + y >= p and x + y + p >= LEAST:
            found.append((b - p - x, b + y, p))
    return [(s, e, p) for s, e, p in found if (s == 0 or w[s - 1] != w[s - 1 + p]) and (e == n or w[e] != w[e - p])]


def runs_of(w: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers from 0, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[tuple[int, int]]] = {}
    before = 0
    for b, c, source in [*factors(w), (len(w), len(w), -1)]:
        # A run that ends in w[b:c] starts less than twice the factor before and once this one to the left.
        a = max(0, b - 2 * before - (c - b))
        if c - a >= LEAST:
            for s, e, p in _touching(w, a, b, c):
                if (s, e) not in found:
                    by_start.setdefault(s, []).append((e, p))
                elif p < found[s, e]:
                    by_start[s] = [x for x in by_start[s] if x[0] != e] + [(e, p)]
                found[s, e] = min(p, found.get((s, e), p))
        if source >= 0 and by_start and c - b > LEAST:
            way, end = b - source, c - b + source
            for s in range(source + 1, end - LEAST):  # copies can be copied on where the occurrences overlap
                for e, p in by_start.get(s, ()):
                    if e < end and (s + way, e + way) not in found:
                        found[s + way, e + way] = p
                        by_start.setdefault(s + way, []).append((e + way, p))
        before = c - b
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda x: (x[0], x[2]))


def _stretches(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) inside the documents that bounds delimit in which runs can lie."""
    begin, end = bounds[:-1], bounds[1:]
    while True:
        fits = end - begin >= LEAST
        begin, end = begin[fits], end[fits]
        if not len(begin):
            return []
        sizes = end - begin
        scope = np.repeat(np.arange(len(begin)), sizes)
        at = np.arange(len(scope)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        w = (codes[at].astype(np.uint64) + np.uint64(1)) * _TIMES
        n = len(w) - SEED + 1
        key = scope[:n].astype(np.uint64)
        for k in range(SEED):
            key = (key ^ w[k : k + n]) * _TIMES
            key ^= key >> np.uint64(29)
        inside = scope[:n] == scope[SEED - 1 :]
        where = np.flatnonzero(inside)
        order = where[np.argsort(key[where], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, order[again], 1)
        np.add.at(edge, order[again] + SEED, -1)
        covered = np.cumsum(edge[:-1]) > 0
        new = covered & np.concatenate([[True], ~covered[:-1] | (scope[1:] != scope[:-1])])
        last = covered & np.concatenate([~covered[1:] | (scope[1:] != scope[:-1]), [True]])
        was = int(sizes.sum())
        begin, end = at[new], at[last] + 1
        if int((end - begin).sum()) == was and len(begin) == len(sizes):
            return list(zip(begin.tolist(), end.tolist(), strict=True))


def _batch(keys: list[pa.Array], lists: pa.ListArray, names: list[str]) -> pa.RecordBatch:
    bounds = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    codes = values.dictionary_encode().indices.to_numpy()
    mine: list[list[tuple[int, int, int]]] = [[] for _ in range(len(lists))]
    gone = np.zeros(len(codes) + 1, np.int64)
    for a, b in _stretches(codes, bounds):
        doc = int(np.searchsorted(bounds, a, side="right")) - 1
        for s, n, p in runs_of(np.unique(codes[a:b], return_inverse=True)[1].tolist()):
            mine[doc].append((a + s - int(bounds[doc]), n, p))
            gone[a + s + p] += 1
            gone[a + s + n] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(stays)])[bounds]
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), values.filter(pa.array(stays))), " ")
    flat = np.array([x for r in mine for x in r], np.int64).reshape(-1, 3)
    struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, mine)]), pa.int32()), struct)
    return pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(bounds)), runs, kept], names=[*names, "n_words", "runs", "kept"])


def _search(batches):
    for batch in batches:
        lists, at = batch.column(batch.num_columns - 1), 0
        off = lists.offsets.to_numpy()
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + FLUSH, side="right")) - 1)
            yield _batch([c.slice(at, to - at) for c in batch.columns[:-1]], lists.slice(at, to - at), batch.schema.names[:-1])
            at = to


def found(docs: DataFrame, keys: list[str], tokens: Column | None = None, text: str = "text") -> DataFrame:
    """keys, n_words, runs (start, length and period in words, by start, then period) and kept: the text without the words that stand in a run after its first period,
    words joined by one space. tokens, an array of strings without nulls, stands for the words of the text where it is given.

    Null and empty texts have no words and no runs. Texts of any length are taken whole; a stretch that repeats takes about 300 bytes a word while it is searched. One interval is
    one run, with its smallest period; runs can overlap. Rows are handled one by one: repeated rows give equal results, an empty table none. Other columns are not read;
    n_words, runs and kept may not be keys."""
    d = docs.select(*keys, (words(F.col(text)) if tokens is None else tokens).alias("__words"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return d.mapInArrow(_search, f"{head}, {_RESULT}")

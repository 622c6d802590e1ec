"""SentencePiece encoding and decoding by N-best segmentation over the piece lattice.

A text becomes pieces as the model file says: a space in front, spaces written as U+2581, and characters that no piece covers as their UTF-8 bytes.
Forward Viterbi gives the best score from the start to each place; those scores are exact heuristics for a backward A-star search
from the end, which so pops segmentations best first. Pieces never hold U+2581 after another character, so the lattice falls into units,
one per word, and those into parts wherever no piece holds the two characters side by side.

Each distinct unit of a run of texts is searched once for its best way; what then heads the agenda is the score of its next best one. A text's N best change
few of its units, those with the least gaps between their best and next best ways, and only there does the search go on to N ways."""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from bisect import bisect_left
from functools import lru_cache
from itertools import chain, pairwise
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import give_back

SPACE = "▁"
N_BEST = 4
#: An unknown character costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes that a worker's cache of units may take, about; characters of text in a run; units longer than this are cut at every place where that can be done.
CACHE_BYTES, CHARS, LONG_UNIT = 96 << 20, 3 << 20, 200
#: Parts up to this length are searched in step, so many characters at a time.
STEPPED, BLOB = 48, 1 << 16
_INF = float("inf")
_LAST = itemgetter(0)
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Kept:
    """A function's values by text, in two generations: when the new one has its bytes it becomes the old one, and what is still in use moves up."""

    def __init__(self, make, limit: int, at_once=None):
        """at_once: a function that gives the values of a list of texts, by text."""
        self.make, self.limit, self.new, self.old, self.bytes = at_once or (lambda texts: {t: make(t) for t in texts}), limit // 2, {}, {}, 0

    def all(self, texts) -> list:
        new, old, made = self.new, self.old, []
        for t in set(texts).difference(new):
            value = old.get(t)
            if value is None:
                made.append(t)
            else:
                new[t] = value
            self.bytes += 400 + 6 * len(t)
        new.update(self.make(made))
        out = list(map(new.__getitem__, texts))
        if self.bytes > self.limit:
            self.old, self.new, self.bytes = new, {}, 0
        return out

    def seen(self, text: str):
        """The value if it is at hand."""
        return self.new.get(text) or self.old.get(text)


class Pieces:
    """The vocabulary of a model file, and the search over it. Models with a normaliser, with whitespace that is dropped or follows its word, or with pieces of a
    user's own are refused."""

    def __init__(self, path: str, n_best: int = N_BEST, cache: int = CACHE_BYTES):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises texts or moves white space, which is not handled")
        self.n_best, self.cache, self.dummy = n_best, cache, norm.add_dummy_prefix
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte_ids, self.bytes_of = [-1] * 256, []
        worst = 0.0
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == _NORMAL:
                if SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece:
                    raise ValueError(f"piece {p.piece!r} reaches over a unit")
                self.ids[p.piece] = (i, p.score)
                if p.score > -1e8:
                    worst = min(worst, p.score)
                self.bytes_of.append(p.piece.replace(SPACE, " ").encode())
            elif p.type in (_UNKNOWN, _CONTROL):
                self.bytes_of.append(b"")
            else:
                raise ValueError(f"piece {p.piece!r} of kind {p.type} is not handled")
        if -1 in self.byte_ids:
            raise ValueError("the model has no piece for every byte")
        self.unknown = worst - UNKNOWN_PENALTY
        self.singles = {k for k in self.ids if len(k) == 1}
        self.finder = ahocorasick.Automaton()
        for k, (i, score) in self.ids.items():
            self.finder.add_word(k, i)
        self.finder.make_automaton()
        self.edge, self.sizes, self.scores = {}, np.zeros(len(proto.pieces), np.int64), np.zeros(len(proto.pieces))
        for k, (i, score) in self.ids.items():
            self.edge[i] = len(k), i, score
            self.sizes[i], self.scores[i] = len(k), score
        self.plain = pa.array(self.bytes_of, pa.binary())
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.forget()

    def forget(self) -> None:
        """Empties the caches."""
        self.kept, self.ways_kept = Kept(None, self.cache, self._units), Kept(self.ways, self.cache // 8)

    # --- the search -----------------------------------------------------------------------------------------------------------------------

    def _lattice(self, part: str):
        """The edges, (last character, (length, id or -1 for an unknown character, score)), by last character, and for each place the best score of a way to it (forward
        Viterbi)."""
        edge = self.edge
        edges = [(last, edge[i]) for last, i in self.finder.iter(part)]
        if not self.singles.issuperset(part):
            edges = sorted(edges + [(i, (1, -1, self.unknown)) for i, c in enumerate(part) if c not in self.singles], key=_LAST)
        best = [-_INF] * (len(part) + 1)
        best[0] = 0.0
        for last, (size, _, s) in edges:
            last += 1
            s += best[last - size]
            if s > best[last]:
                best[last] = s
        return edges, best

    @staticmethod
    def _ending(edges: list, at: int) -> list[tuple[int, int, float]]:
        """The edges that end at a place, (length, id, score), the longest first."""
        return [e[1] for e in edges[bisect_left(edges, (at - 1,)) : bisect_left(edges, (at,))]]

    def _bytes_at(self, part: str, a: int, b: int, i: int) -> list[int]:
        return [i] if i >= 0 else [self.byte_ids[x] for x in part[a:b].encode()]

    def _first(self, part: str) -> tuple[list[int], float, float]:
        """ids and score of the best way, and the gap to the next best one (infinite where there is none).

        This is the A-star search up to its first whole way. Its heuristics are exact, so it only ever goes on from the place where it is, and the other edges there
        stay on the agenda; the best of them all is the next best way."""
        if len(part) == 1:
            found = self.ids.get(part)
            return ([found[0]], found[1], _INF) if found else ([self.byte_ids[x] for x in part.encode()], self.unknown, _INF)
        edges, best = self._lattice(part)
        at, score, agenda, ids, k = len(part), 0.0, -_INF, [], len(edges) - 1
        while at:
            top = -_INF
            while edges[k][0] >= at:
                k -= 1
            while k >= 0 and edges[k][0] == at - 1:
                edge = edges[k][1]
                f = edge[2] + score + best[at - edge[0]]
                if f >= top:  # of equal ones the longest, which stands first
                    top, way, f = f, edge, top
                if f > agenda:
                    agenda = f
                k -= 1
            size, i, s = way
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.byte_ids[x] for x in reversed(part[at - size : at].encode())]
            at -= size
            score += s
        ids.reverse()
        return ids, score, max(0.0, score - agenda) if agenda > -_INF else _INF

    def segment(self, part: str, wanted: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The n_best segmentations, best first: score, ids (unknown characters as bytes). Of equal scores the one with the longer last piece comes
        first, then the one with the longer last but one, and so on.

        Every partial way on the agenda stands for at least one whole way of exactly its estimated score, and no two for the same one, so the agenda never
        needs more ways than are still wanted."""
        (edges, best), wanted = self._lattice(part), wanted or self.n_best
        # Partial ways from the end: (-(score so far + best[place]), starts of the pieces so far, place, score so far, ids), least first.
        agenda, out = [(-best[-1], (), len(part), 0.0, ())], []
        while agenda and len(out) < wanted:
            _, starts, at, score, ids = agenda.pop(0)
            if at == 0:
                out.append((score, ids))
                continue
            more = [(-(s + score + best[at - n]), (*starts, at - n), at - n, s + score, (*self._bytes_at(part, at - n, at, i), *ids)) for n, i, s in self._ending(edges, at)]
            agenda = sorted(agenda + more, key=lambda x: x[:2])[: wanted - len(out)]
        return out

    @staticmethod
    def _whole(unit: str) -> bool:
        return len(unit) <= LONG_UNIT and unit.lstrip(SPACE).isalpha()

    def parts(self, unit: str) -> list[str]:
        """The unit cut where no piece reaches over. Words of letters alone, which hardly ever have such a place, are not looked at."""
        if self._whole(unit):
            return [unit]
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.joined]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def _part(self, part: str) -> tuple[bytes, float, float, bytes]:
        ids, score, gap = self._first(part)
        return array("I", ids).tobytes(), score, gap, b"".join(map(self.bytes_of.__getitem__, ids))

    def _parts(self, parts: list[str]) -> list[tuple[bytes, float, float, bytes]]:
        """What _part() gives for each of parts, which hold two characters at least, all of them pieces: the same search in step for all.

        Places count through the parts between line feeds, which no piece holds. Edges come by their last character, the longest first."""
        n, sizes = len(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(sizes + 1) - sizes - 1
        flat = np.fromiter(chain.from_iterable(self.finder.iter("\n".join(parts))), np.int64).reshape(-1, 2)
        to, piece = flat[:, 0] + 1, flat[:, 1]
        back, scores = to - self.sizes[piece], self.scores[piece]
        # Forward Viterbi, one place of all parts after another.
        best = np.full(int(start[-1] + sizes[-1]) + 2, -_INF)
        best[start] = 0.0
        local = (to - np.repeat(start, sizes + 1)[to - 1]).astype(np.int16)
        order = np.argsort(local, kind="stable")
        level = np.searchsorted(local[order], np.arange(1, int(sizes.max()) + 2))
        for a, b in pairwise(level.tolist()):
            e = order[a:b]
            first = np.flatnonzero(np.diff(to[e], prepend=-1))
            best[to[e[first]]] = np.maximum.reduceat(scores[e] + best[back[e]], first)
        # Back from the ends, as in _first().
        count = np.bincount(to, minlength=len(best))
        head = np.cumsum(count) - count
        at, score, agenda, active, steps = start + sizes, np.zeros(n), np.full(n, -_INF), np.arange(n), []
        while len(active):
            many = count[at[active]]
            ends = np.cumsum(many)
            own = ends - many
            e = np.repeat(head[at[active]] - own, many) + np.arange(ends[-1])
            f = scores[e] + np.repeat(score[active], many) + best[back[e]]
            tops = np.flatnonzero(f == np.repeat(np.maximum.reduceat(f, own), many))
            top = tops[np.searchsorted(tops, own)]  # of equal ones the longest, which stands first
            f[top] = -_INF
            agenda[active] = np.maximum(agenda[active], np.maximum.reduceat(f, own))
            e = e[top]
            steps.append((active, piece[e]))
            score[active] += scores[e]
            at[active] = back[e]
            active = active[at[active] > start[active]]
        owner = np.concatenate([x for x, _ in reversed(steps)])
        ids = np.concatenate([x for _, x in reversed(steps)])[np.argsort(owner, kind="stable")]
        gap = np.where(agenda > -_INF, np.maximum(0.0, score - agenda), _INF)
        text = self.plain.take(pa.array(ids))
        ends = np.cumsum(np.bincount(owner, minlength=n))
        text_ends = np.frombuffer(text.buffers()[1], np.int32, len(ids) + 1)[ends].tolist()
        raw, raw_text, ends = ids.astype("<u4").tobytes(), text.buffers()[2].to_pybytes(), (4 * ends).tolist()
        return [(raw[a:b], s, g, raw_text[c:d]) for a, b, s, g, c, d in zip([0, *ends], ends, score.tolist(), gap.tolist(), [0, *text_ends], text_ends)]  # noqa: B905

    def _found(self, parts: list[str]) -> dict[str, tuple[bytes, float, float, bytes]]:
        """What _part() gives, by part. Long parts and those with unknown characters are searched one by one."""
        strange = set().union(*parts) - self.singles
        some = [x for x in parts if 1 < len(x) <= STEPPED and (not strange or strange.isdisjoint(x))]
        out, at, size = {}, 0, 0
        for k, x in enumerate(some, 1):
            size += len(x) + 1
            if size > BLOB or k == len(some):
                out.update(zip(some[at:k], self._parts(some[at:k]), strict=True))
                at, size = k, 0
        if len(some) < len(parts):
            out.update((x, self._part(x)) for x in parts if x not in out)
        return out

    def _units(self, units: list[str]) -> dict[str, tuple[bytes, float, float, bytes]]:
        """By unit: ids (little-endian uint32) and score of the best way, the gap to the next best one, and the bytes that the ids decode to."""
        whole, cut = [], []
        for x in units:
            (whole if self._whole(x) else cut).append(x)
        out, cut = self._found(whole), [(x, self.parts(x) if x else ()) for x in cut]
        seen = self.kept.seen
        found = {x: out.get(x) or seen(x) for x in {x for _, parts in cut for x in parts}}  # a part is often a unit elsewhere
        found.update(self._found([x for x, value in found.items() if value is None]))
        for x, parts in cut:
            f = [found[p] for p in parts]
            out[x] = f[0] if len(f) == 1 else (b"".join([v[0] for v in f]), sum([v[1] for v in f]), min([v[2] for v in f], default=_INF), b"".join([v[3] for v in f]))
        return out

    def _sums(self, choices: list[list[float]]) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """Of ways to choose from each member of a sequence (gaps ascending from 0) the n_best: gap, and (member, choice) wherever that is not the first. Of
        equal gaps the one that changes an earlier member comes first, then the one with the earlier choice there."""
        sums = [(0.0, ())]
        for m, gaps in enumerate(choices):
            sums = sorted((a + g, (*c, (m, k)) if k else c) for a, c in sums for k, g in enumerate(gaps))[: self.n_best]
        return sums

    def ways(self, unit: str) -> list[tuple[float, bytes]]:
        """The n_best ways of a unit from the N-best search over its parts: gap to the best, ids."""
        found = [self.segment(p) for p in self.parts(unit)]
        sums = self._sums([[max(0.0, f[0][0] - x[0]) for x in f] for f in found])
        return [(g, array("I", [i for m, f in enumerate(found) for i in f[dict(c).get(m, 0)][1]]).tobytes()) for g, c in sums]

    # --- texts ----------------------------------------------------------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        return _UNIT.findall((SPACE if self.dummy and text else "") + text.replace(" ", SPACE))

    def _split(self, text: str) -> str:
        """The units of a text between zero bytes; empty ones mean nothing. Only for texts without a zero byte."""
        if text[:1] == " " or "  " in text or SPACE in text:
            return "\0".join(self.units(text))
        return (SPACE if self.dummy and text else "") + text.replace("\n", "\0\n\0").replace(" ", f"\0{SPACE}")

    def encode(self, texts: list[str]) -> list[tuple]:
        """Of each text: the n_best ways, best first, as (score, ids in little-endian uint32), and the bytes that the best one decodes to.

        Equal scores come by the place of the first unit that is not in its best way, then by the rank of its way."""
        zero = [i for i, t in enumerate(texts) if "\0" in t]
        out = self._encode(pc.split_pattern(pa.array([self._split("" if "\0" in t else t) for t in texts], pa.large_string()), "\0"))
        for i, x in zip(zero, self._encode(pa.array([self.units(texts[i]) for i in zero], pa.large_list(pa.large_string()))) if zero else (), strict=True):
            out[i] = x
        return out

    def _encode(self, lists) -> list[tuple]:
        coded = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        names, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        found = self.kept.all(names)
        joined = lambda k: pa.array([f[k] for f in found], pa.large_binary()).take(coded.indices)
        ids, plain = joined(0), joined(3)
        place, text_place = (np.frombuffer(x.buffers()[1], np.int64, len(x) + 1, 8 * x.offset) for x in (ids, plain))
        raw, raw_text = (memoryview(x.buffers()[2] or b"") for x in (ids, plain))
        score = np.array([f[1] for f in found], float)[code]
        gap = np.array([f[2] for f in found], float)[code]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            start, end = int(place[a]), int(place[b])
            best, total = bytes(raw[start:end]), float(score[a:b].sum())
            # A way that changes a unit which is not among the n_best - 1 with the least gaps has as many single changes before it.
            g = gap[a:b]
            if len(g) > 64:
                limit = np.partition(g, self.n_best - 2)[self.n_best - 2] if self.n_best > 1 else -1.0
                some = np.flatnonzero(g <= limit)
                some = some[np.argsort(g[some], kind="stable")][: self.n_best - 1]
            else:
                some = np.argsort(g, kind="stable")[: self.n_best - 1]
            some = sorted(i for i in some.tolist() if g[i] < _INF)
            choices = self.ways_kept.all([names[code[a + i]] for i in some])
            ways = [(total, best)]
            for less, changes in self._sums([[w[0] for w in c] for c in choices])[1:]:
                at, pieces = 0, []
                for m, k in changes:
                    u = a + some[m]
                    pieces += [best[at : int(place[u]) - start], choices[m][k][1]]
                    at = int(place[u + 1]) - start
                ways.append((total - less, b"".join([*pieces, best[at:]])))
            out.append((ways, bytes(raw_text[int(text_place[a]) : int(text_place[b])])))
        return out

    def undo(self, data: bytes) -> str:
        """Bytes of pieces as a text: those that are not UTF-8 together become U+FFFD."""
        return (data[1:] if self.dummy and data[:1] == b" " else data).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.undo(b"".join(map(self.bytes_of.__getitem__, ids)))


@lru_cache(maxsize=2)
def pieces(path: str, n_best: int = N_BEST, cache: int = CACHE_BYTES) -> Pieces:
    return Pieces(path, n_best, cache)


def _lists(values: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    ends = np.cumsum([0, *(len(v) // 4 for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<i4")))


def _runs(texts: pa.Array, chars: int = CHARS):
    """Bounds of runs of texts with about so many characters."""
    ends, at = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, side="right")))
        yield at, to
        at = to


def encoded(docs: DataFrame, model: str, keys: list[str], text: str = "text", n_best: int = N_BEST, ways: bool = False, cache: int = CACHE_BYTES, chars: int = CHARS) -> DataFrame:
    """keys, ids (array<int>, the best segmentation), score, nbest (array<double>, scores of the best n_best segmentations of the whole text), nbest_crc32
    (array<long>, of the ids of each as little-endian uint32), ids_crc32 (of the best), n_pieces, and exact: whether decoding the ids gives the text back. With ways,
    also ways (array<array<int>>): the ids of each of the n_best segmentations.

    Null and empty texts have no pieces, score 0 and one segmentation. Texts of any length are taken whole. Of segmentations of equal score, the one comes first
    whose first unit out of its best way stands earlier; within a unit, the one with the longer last piece. A text that itself holds U+2581 decodes to a space
    there, so exact is false. Rows are handled one by one: repeated rows give equal results, an empty table none. Other columns are not read. cache: bytes in which a worker keeps units that it has found, chars: characters of
    text that it takes at a time; fewer of either take more time."""

    def of(batch, texts, a, b, got, p):
        sums = [[zlib.crc32(w[1]) for w in g[0]] for g in got]
        arrays = [
            *[c[a:b] for c in batch.columns[:-1]],
            _lists([g[0][0][1] for g in got]),
            pa.array([g[0][0][0] for g in got], pa.float64()),
            pa.array([[w[0] for w in g[0]] for g in got], pa.list_(pa.float64())),
            pa.array(sums, pa.list_(pa.int64())),
            pa.array([s[0] for s in sums], pa.int64()),
            pa.array([len(g[0][0][1]) // 4 for g in got], pa.int64()),
            pa.array([p.undo(g[1]) == t for g, t in zip(got, texts, strict=True)], pa.bool_()),
        ]
        if ways:
            count = np.cumsum([0, *(len(g[0]) for g in got)])
            arrays.append(pa.ListArray.from_arrays(pa.array(count, pa.int32()), _lists([w[1] for g in got for w in g[0]])))
        return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "ids", "score", "nbest", "nbest_crc32", "ids_crc32", "n_pieces", "exact", *["ways"] * ways])

    def run(batches):
        give_back()  # what a worker holds from the tasks of other stages
        p = pieces(model, n_best, cache)
        gc.disable()  # the caches hold many tuples and no cycles
        try:
            for batch in batches:
                column = pc.fill_null(batch.column(batch.num_columns - 1), "")
                for a, b in _runs(column, chars):
                    texts = column[a:b].to_pylist()
                    yield of(batch, texts, a, b, p.encode(texts), p)
        finally:  # a worker that waits for its next task holds the vocabulary alone
            gc.enable()
            p.forget()
            give_back()

    kept = docs.select(*keys, F.col(text).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return kept.mapInArrow(run, f"{head}, ids array<int>, score double, nbest array<double>, nbest_crc32 array<long>, ids_crc32 long, n_pieces long, exact boolean" + ", ways array<array<int>>" * ways)


def decoded(docs: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """docs with column to: the text of each array of ids. Null ids give null, an empty array the empty text."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        p = pieces(model)
        return pa.array([None if v is None else p.decode(v) for v in x.to_pylist()], pa.string())

    return docs.withColumn(to, run(ids))

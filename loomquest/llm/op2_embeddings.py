"""Embedding near-dedup by iterative quantisation.

Rotations learned on a bounded sample turn vectors into balanced binary codes: the sample's mean is taken off, each rotation spreads the variance over its bits, and
each bit is cut at its median. Codes that nearly agree in some segment are retrieved through multi-index Hamming tables, pairs whose whole codes are
near are reranked with the original vectors in double precision. Equal vectors are one entry with a size. The members of candidate pairs are multiplied as
matrices, block by block, each block giving counts and a spanning forest of its links, so pairs never carry vectors.

Every length of vector has codes of its own. A tight group (many vectors around one direction, whose pairs the codes of the whole cannot tell apart) gets a space of its own:
codes learned on what is left of its vectors beside their own mean. See Space."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import components, discard, saved

THRESHOLD = 0.9
#: Vectors that the codes are learned on, at most; every vector is indexed.
SAMPLE, TURNS, SEED = 20_000, 30, 7
#: Bits of a segment; the balls have radius 1, at every size.
WIDTH = 16
#: Tables: the least number, in steps, that finds this share of pairs at the threshold in the sample.
LEAST_TABLES, STEP, MOST_TABLES, RECALL = 8, 4, 64, 0.975
#: Shares of the mean to take off, the first that reaches the recall. All of it gives even codes; less serves tables that are one tight group, where what is left
#: beside the mean is noise.
CENTRES = (1.0, 0.75, 0.5, 0.0)
#: Of the pairs at the threshold in the sample, this share has codes within the distance that is reranked.
WITHIN, OTHERS = 0.998, 0.002
#: The same for codes that are compared by angles beside the mean, where unrelated pairs are close behind.
WITHIN_ANGLE = 0.98
#: A length has learned codes if it holds one of so many vectors, a group if it holds one of so many of its length; both need FEW vectors in the sample. Spaces are few, since
#: each task holds the projections of all.
SHARE, FEW, LENGTHS, SPACES = 200, 100, 32, 64
#: Vectors a dimension from which rotations are learned in a group.
FIT = 8
#: A group gets codes of its own if the codes at hand retrieve this share of its pairs that are no links, and its own ones at most half of them.
LOOSE = 0.01
CHUNK, JOBS_A_BUNDLE = 512, 200


def _fine(vec: str = "embedding") -> Column:
    """Whether a vector can link: not null or empty, all components finite, not all zero."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))


def _unit(rows) -> np.ndarray:
    """Unit vectors of rows of one length."""
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- codes ------------------------------------------------------------------------------------------------------------------------------


class _Rotations:
    """A projection for vectors, made as far as it is asked for: frames in the space of the principal directions of the centred sample and its mean, each turned by alternating
    between the nearest binary codes and the best rotation onto them, which spreads the variance evenly over its bits."""

    def __init__(self, x: np.ndarray, seed: int, turns: int = TURNS):
        mean, self.turns, self.rng, d = x.mean(axis=0), turns, np.random.default_rng(seed), x.shape[1]
        self.x, self.mean = x - mean, mean
        value, vector = np.linalg.eigh(self.x.T @ self.x)
        self.basis = vector[:, np.argsort(-value)[: min(d, 256)]]
        if self.basis.shape[1] < d:
            self.basis = np.linalg.qr(np.concatenate([self.basis, mean[:, None]], axis=1))[0]
        self.made, self.medians = np.zeros((d, 0)), np.zeros(0)

    def first(self, bits: int) -> np.ndarray:
        while self.made.shape[1] < bits:
            n = min(64, self.basis.shape[1])
            frame = self.basis @ np.linalg.qr(self.rng.standard_normal((self.basis.shape[1], n)))[0]
            p, rotation = self.x @ frame, np.linalg.qr(self.rng.standard_normal((n, n)))[0]
            for _ in range(self.turns):
                u, _, vt = np.linalg.svd(np.where(p @ rotation >= 0, 1.0, -1.0).T @ p)
                rotation = (u @ vt).T
            self.made = np.concatenate([self.made, frame @ rotation], axis=1)
            self.medians = np.concatenate([self.medians, np.median(p @ rotation, axis=0) + self.mean @ frame @ rotation])
        return self.made[:, :bits]


class Codes:
    """What turns unit vectors into codes, as int64 words: projection, and the cut of each bit; tables: the segments looked up, which are the first bits; check: the words before those
    that are compared as a whole (0: all are); far: the most bits in which those of pairs at the threshold differ; recall: of such pairs in the sample.

    Codes with an axis (check is not 0 then) are of vectors that share that direction, and are compared beside it: from the cosines of both ends with the axis follows which angle they may have
    beside it to reach the threshold, hence in how many bits they are to differ; far is how many more are allowed."""

    def __init__(self, projection: np.ndarray, cut: np.ndarray, tables: int, far: float, recall: float, axis: np.ndarray | None = None, check: int = 0):
        self.projection, self.cut, self.tables, self.far, self.recall, self.axis, self.check = projection, cut, tables, far, recall, axis, check
        self.words = -(-projection.shape[1] // 64)
        #: Bits that are compared by angle.
        self.turned = 0 if axis is None else len(cut) - check * 64

    def bits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.projection >= self.cut

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of x by words."""
        bits = np.zeros((len(x), self.words * 64), np.uint8)
        bits[:, : len(self.cut)] = self.bits(x)
        return np.packbits(bits, axis=1, bitorder="little").view("<i8")

    def strangers(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """For each two rows of x, whether their codes are near enough to be reranked though they do not link."""
        signs = np.where(self.bits(x)[:, self.check * 64 :], 1, -1).astype(np.float32)
        far = self.far
        if self.axis is not None:
            e, se = beside(x, self.axis)
            far = far + self.turned * _angle(threshold * np.outer(e, e) - np.outer(se, se))
        return (signs.shape[1] - signs @ signs.T <= 2 * far) & (x @ x.T < threshold)


def beside(x: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of x the inverse of the length of what lies beside the axis, and the cosine with the axis times that. Of two rows at cosine c, what lies beside it has the
    cosine c * e1 * e2 - se1 * se2."""
    s = np.clip(x @ axis, -1 + 1e-9, 1 - 1e-9)
    e = 1 / np.sqrt(1 - s * s)
    return e, s * e


def _angle(cosine: np.ndarray) -> np.ndarray:
    """As a share of the half circle."""
    return np.arccos(np.clip(cosine, -1, 1)) / np.pi


def planes(d: int, threshold: float = THRESHOLD) -> Codes:
    """Codes for vectors of a length that is too rare to learn from: random hyperplanes through the origin, fixed by the length. The share of bits in which a pair at the threshold
    differs is known, and gives tables and far."""
    apart = np.arccos(threshold) / np.pi
    missed = 1 - (1 - apart) ** WIDTH - WIDTH * apart * (1 - apart) ** (WIDTH - 1)
    steps = range(LEAST_TABLES, MOST_TABLES + 1, STEP)
    tables = next((t for t in steps if 1 - missed**t >= RECALL), MOST_TABLES)
    bits = tables * WIDTH
    far = int(np.ceil(bits * apart + 3 * np.sqrt(bits * apart * (1 - apart))))
    return Codes(np.random.default_rng([SEED, d]).standard_normal((d, bits)), np.zeros(bits), tables, far, 1 - missed**tables)


def _partners(x: np.ndarray, threshold: float, rng) -> np.ndarray:
    """For each sample vector one at the threshold: on the way to another one of the sample, or that one itself where it is nearer."""
    other = x[rng.permutation(len(x))]
    cos = np.clip((x * other).sum(axis=1, keepdims=True), -1, 1)
    side = other - cos * x
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    random = rng.standard_normal(x.shape)
    random -= (random * x).sum(axis=1, keepdims=True) * x
    side = np.where(norm > 1e-6, side / np.maximum(norm, 1e-6), random / np.maximum(np.linalg.norm(random, axis=1, keepdims=True), 1e-9))
    return np.where(cos >= threshold, other, threshold * x + np.sqrt(1 - threshold**2) * side)


def learn(x: np.ndarray, threshold: float = THRESHOLD, seed: int = SEED, group: bool = False) -> Codes:
    """Codes from a sample of unit vectors. The share of the mean taken off is the first of CENTRES, and the number of tables the least one, by which RECALL of the pairs at
    the threshold agree in some segment but for one bit; if none does, the ones that find most. The bits compared as a whole are so many that they tell other pairs (all but OTHERS of them)
    from pairs at the threshold. They are the tables' and more like them, unless not all of the mean is off or the sample is of a group: then they are bits of their own, cut at their medians
    and compared by angles beside the mean."""
    rng, mean = np.random.default_rng(seed), x.mean(axis=0)
    # A group's sample is small. Rotations learned on too few vectors fit those closely and tell nothing of others: they stay as drawn. What rotations learned on one half do
    # to pairs is seen on the other.
    fit, held = (x[::2], np.repeat(x[1::2], max(1, 2000 // len(x)), axis=0)) if group else (x, x)
    some = held[rng.permutation(len(held))[:4000]] if len(held) > 1 else np.repeat(x, 2, axis=0)
    y = _partners(some, threshold, rng)
    turn = rng.permutation(len(some))
    below = (some * some[turn]).sum(axis=1) < threshold
    rotations = _Rotations(fit, seed, 0 if group and len(fit) < FIT * x.shape[1] else TURNS)

    def tried(centre: float, tables: int):
        """Projection and cuts of so many tables, bits in which the pairs at the threshold differ by table, and those of other pairs."""
        projection = rotations.first(tables * WIDTH)
        cut = rotations.medians[: tables * WIDTH] if centre == 1 else centre * mean @ projection
        bits = some @ projection >= cut
        apart = lambda b: (bits != b).reshape(len(some), tables, WIDTH).sum(axis=2)
        return projection, cut, apart(y @ projection >= cut), apart(bits[turn])[below]

    recall = -1.0
    for share in CENTRES:
        for t in range(LEAST_TABLES, MOST_TABLES + 1, STEP):
            got = float((tried(share, t)[2] <= 1).any(axis=1).mean())
            if got >= RECALL:
                break
        if got > recall:
            centre, tables, recall = share, t, got
        if got >= RECALL:
            break
    axis = mean / max(np.linalg.norm(mean), 1e-12) if group or centre != 1 else None
    awaited, unlike = 0.0, 0.0  # shares of the bits in which pairs are to differ
    if axis is not None:
        (e, se), (ye, yse) = beside(some, axis), beside(y, axis)
        awaited, unlike = _angle(threshold * e * ye - se * yse), _angle(threshold * e * e[turn] - se * se[turn])[below]
    for length in range(LEAST_TABLES if axis is not None else tables, MOST_TABLES + 1, STEP):
        projection, cut, differ, others = tried(1.0, length)
        far = float(np.quantile(differ.sum(axis=1) - awaited * len(cut), WITHIN if axis is None else WITHIN_ANGLE, method="higher"))
        far = max(far, 0.0)  # partners nearer than the threshold differ in fewer bits than are awaited
        if (others.sum(axis=1) - unlike * len(cut) <= far).sum() <= OTHERS * len(others):
            break
    if axis is None:
        return Codes(projection, cut, tables, far, recall)
    looked, its_cut = tried(centre, tables)[:2]
    return Codes(np.concatenate([looked, projection], axis=1), np.concatenate([its_cut, cut]), tables, far, recall, axis, tables * WIDTH // 64)


class Space:
    """Codes, and who is compared by them: the vectors of one length whose cosine with the centre is at least ball (without a centre: all), but for those in the core of one of the space's
    own groups. A group's core is a cosine with its centre; its ball reaches as far as a vector at the threshold from one in the core can lie, so both ends of a
    link with an end in the core are in the ball, and no link falls between two spaces."""

    def __init__(self, codes: Codes, centre: np.ndarray | None = None, core: float = -2.0, threshold: float = THRESHOLD):
        self.codes, self.centre, self.core, self.groups = codes, centre, core, []
        self.ball = -2.0 if centre is None else float(np.cos(min(np.pi, np.arccos(core) + np.arccos(threshold)))) - 1e-9

    def reached(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), bool) if self.centre is None else x @ self.centre >= self.ball

    def inside(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), bool) if self.centre is None else x @ self.centre >= self.core


def _crowds(x: np.ndarray, codes: Codes, threshold: float):
    """Centre and core of each tight group, seen from a few thousand vectors of x: the vector that has most strangers within reach of its code, and the direction that it shares with them."""
    some = x[np.random.default_rng(SEED).permutation(len(x))[:4000]]
    near, free = codes.strangers(some, threshold), np.ones(len(some), bool)
    weights = near.astype(np.float32)
    while True:
        count = weights @ free.astype(np.float32) * free
        seed = int(count.argmax())
        if count[seed] < max(20, len(some) / SHARE):
            return
        own = near[seed] & free
        for _ in range(3):
            centre = some[own].mean(axis=0)
            centre /= max(np.linalg.norm(centre), 1e-12)
            cos = some @ centre
            core = float(np.quantile(cos[own], 0.01))
            own = free & (cos >= core)
        yield centre, max(-1.0, core - 0.01)
        free &= cos < core
        free[seed] = False


def learned(x: np.ndarray, threshold: float = THRESHOLD, most: int = SPACES) -> list[Space]:
    """The spaces for vectors of one length, from a sample of them: all, then the tight groups in it, and the tight groups in those; at most so many."""
    spaces = [Space(learn(x, threshold))]
    for space in spaces:  # grows meanwhile
        own = x[space.reached(x)]
        if len(own) < FEW:
            continue
        for centre, core in _crowds(own, space.codes, threshold):
            if len(spaces) >= most:
                break
            group = Space(space.codes, centre, core, threshold)
            ball, inner = own[group.reached(own)], own[group.inside(own) & ~np.any([g.inside(own) for g in space.groups], axis=0)]
            if len(inner) < FEW or len(ball) > min(2 * len(inner), 0.95 * len(own)):
                continue
            before = space.codes.strangers(inner[:2000], threshold).mean()
            if before < LOOSE:
                continue
            group.codes = learn(ball, threshold, group=True)
            if group.codes.strangers(inner[:2000], threshold).mean() <= before / 2:
                space.groups.append(group)
                spaces.append(group)
    return spaces


# --- retrieval --------------------------------------------------------------------------------------------------------------------------


def near_codes(coded: DataFrame, tables: int, words: int, check: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, ahome, b, bhome) of entries of a space that differ in at most one bit of some segment, and in at most far bits of the words from check on (where check is not 0, more than their
    angle beside the axis asks for), each pair of a space once.

    coded: cls (unique in a space), home, space, its tables, far and turned (see Codes), the e and se of beside(), and the words w0, w1, ... of the code. tables: the most of any space. An entry is looked up in its own bucket and in
    those with one more bit set, so that every pair of buckets meets once."""
    mask = F.lit((1 << WIDTH) - 1).cast("long")
    segment = lambda t, x="": F.shiftrightunsigned(f"{x}w{t * WIDTH // 64}" if not isinstance(x, Column) else x, t * WIDTH % 64).bitwiseAND(mask)
    every = F.array(*[F.struct(F.lit(t).alias("t"), segment(t).alias("key")) for t in range(tables)])
    names = ["cls", "home", *(["e", "se"] if check else []), *[f"w{k}" for k in range(words)]]
    of = lambda to: [F.col(c).alias(f"{to}{c}") for c in names]
    rows = coded.select("space", "far", "turned", *names, F.explode(F.slice(every, F.lit(1), F.col("tables"))).alias("s"))
    index = rows.select("space", "s.t", "s.key", *of("b"))
    more = F.filter(F.transform(F.array(*[F.lit(1 << i).cast("long") for i in range(WIDTH)]), lambda x: F.col("s.key").bitwiseOR(x)), lambda k: k != F.col("s.key"))
    probe = rows.select("space", "far", "turned", "s.t", F.explode(F.concat(F.array("s.key"), more)).alias("key"), F.col("s.key").alias("akey"), *of("a"))
    unlike = [F.col(f"aw{k}").bitwiseXOR(F.col(f"bw{k}")) for k in range(words)]
    differ: Column = reduce(lambda a, b: a + b, [F.bit_count(x) for x in unlike[check:]])
    # Met in an earlier table too: that one has the pair.
    earlier = reduce(lambda a, b: a | b, [(F.col("t") > t) & (F.bit_count(segment(t, unlike[t * WIDTH // 64])) <= 1) for t in range(tables)])
    once = (F.col("akey") != F.col("key")) | (F.col("acls") < F.col("bcls"))
    cosine = F.col("ae") * F.col("be") * F.lit(threshold) - F.col("ase") * F.col("bse")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.lit(np.pi)
    far = F.col("far") + F.col("turned") * angle if check else F.col("far")
    pairs = probe.join(index, ["space", "t", "key"]).where(once & (differ <= far) & ~earlier)
    return pairs.select(*[F.col(f"{x}{c}").alias(n) for x in "ab" for c, n in (("cls", x), ("home", f"{x}home"))])


def _forest(links: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least place that each place reaches."""
    label = np.arange(len(links))
    while True:
        least = np.where(links, label[None, :], len(links)).min(axis=1)
        after = np.minimum(label, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _reranked(threshold: float):
    """A bundle of jobs; each has the vectors of one home, or of two (side 0 and 1). Rows cls, links (vectors linked directly, copies counted), root."""

    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        bundle = bundle.sort_values(["ahome", "bhome", "cls"], kind="stable")
        classes, sizes, sides = (bundle[c].to_numpy() for c in ("cls", "size", "side"))
        job, out = bundle[["ahome", "bhome"]].to_numpy(), []
        start = np.flatnonzero(np.concatenate([[True], (job[1:] != job[:-1]).any(axis=1)]))
        for a, b in zip(start, [*start[1:], len(job)], strict=True):
            x = _unit(bundle.embedding.iloc[a:b])
            cls, side = classes[a:b], sides[a:b]
            near = x @ x.T >= threshold
            if side.max() > 0:
                near &= side[:, None] != side[None, :]
            np.fill_diagonal(near, False)
            some = near.any(axis=1)
            if some.any():
                out.append((cls[some], (near @ sizes[a:b])[some], cls[_forest(near)][some]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("cls", "links", "root"), columns, strict=True)))

    return run


_CODED = ["cls", "space", "cell", "own", "tables", "far", "turned", "e", "se"]


class Layout:
    """The spaces of all lengths, and where their codes lie in a row: what is compared by angles starts at the same word in all spaces that have it."""

    def __init__(self, spaces: dict[int, list[Space]], threshold: float = THRESHOLD):
        self.spaces, self.threshold = spaces, threshold
        codes = [s.codes for own in spaces.values() for s in own]
        self.first, self.many = dict(zip(spaces, np.cumsum([0, *map(len, spaces.values())]).tolist())), len(codes)
        self.check = max((c.check for c in codes), default=0)
        whole, split = [c for c in [*codes, planes(2, threshold)] if not c.check], [c for c in codes if c.check]
        self.whole = max(c.tables for c in whole), max(c.words for c in whole)
        self.split = (max(c.tables for c in split), max(self.check + c.words - c.check for c in split)) if split else None
        self.words = max(self.whole[1], self.split[1] if split else 0)
        self.schema = "cls long, space long, cell long, own boolean, tables int, far double, turned int, e double, se double, " + ", ".join(f"w{k} long" for k in range(self.words))

    def of(self, d: int) -> tuple[list[Space], int]:
        """The spaces of a length, and the number of the first."""
        own = self.spaces.get(d)
        return (own, self.first[d]) if own else ([Space(planes(d, self.threshold))], self.many + d)

    def rows(self, x: np.ndarray, spaces: list[Space], first: int):
        """For unit vectors of one length: for each space its number, the places in x of those that take part, whether it is their home, their cells, the codes, what beside() gives, and their words."""
        stays = {id(s): s.reached(x) for s in spaces}  # who takes part
        home = {id(s): np.zeros(len(x), bool) for s in spaces}
        home[id(spaces[0])][:] = True
        for s in spaces:  # a space comes before its groups
            for g in s.groups:
                inside = g.inside(x)
                home[id(g)] |= home[id(s)] & inside
                home[id(s)] &= ~inside
                stays[id(s)] &= ~inside
        for k, s in enumerate(spaces):
            # an entry's home is a space in which it takes part
            at = np.flatnonzero(stays[id(s)])
            if len(at):
                code, c = s.codes.encode(x[at]), s.codes
                words = np.zeros((len(at), self.words), np.int64)
                turned = (np.ones(len(at)), np.zeros(len(at))) if c.axis is None else beside(x[at], c.axis)
                if c.check:
                    words[:, : c.check], words[:, self.check : self.check + c.words - c.check] = code[:, : c.check], code[:, c.check :]
                else:
                    words[:, : c.words] = code
                yield first + k, at, home[id(s)][at], (code[:, c.check] & 0xFFF) | ((first + k) << 12), c, turned, words


def _coded(layout: Layout):
    """The rows of near_codes() without homes, from cls and embedding: one for each space that a vector takes part in. own: of its home space; cell: that and the first bits of its code there."""

    def run(batches):
        spaces: dict[int, tuple[list[Space], int]] = {}
        for batch in batches:
            cls, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            length = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(length).tolist():
                own = np.flatnonzero(length == d)
                for start in range(0, len(own), 2000):
                    part = own[start : start + 2000]
                    flat = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    for number, at, home, cell, codes, (e, se), words in layout.rows(_unit(flat), *spaces.setdefault(d, layout.of(d))):
                        same = lambda v, kind: pa.array(np.full(len(at), v, kind))  # noqa: E731, B023
                        columns = [pa.array(cls[part[at]]), same(number, np.int64), pa.array(cell), pa.array(home), same(codes.tables, np.int32), same(codes.far, np.float64), same(codes.turned, np.int32), pa.array(e), pa.array(se)]
                        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(w)) for w in words.T]], names=[*_CODED, *[f"w{k}" for k in range(layout.words)]])

    return run


def _samples(classes: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """Unit vectors of each length that holds one in SHARE of all n (of the LENGTHS commonest), by length, the commonest first; at most sample of them in all, dealt evenly to the lengths. Which ones hangs on their
    hashes alone. Lengths of which the sample gets fewer than FEW are left out, but for the commonest."""
    size = F.size("embedding")
    counts = classes.groupBy(size.alias("d")).count().where(F.col("count") * SHARE >= n).orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    if not counts:
        counts = classes.groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    each = max(1, sample // len(counts))
    limit = F.create_map(*[F.lit(v) for c in counts for v in (c["d"], int(1_000_000 * min(1.0, 1.1 * each / c["count"])) + 1)])
    drawn = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < limit[size]).orderBy(F.xxhash64("cls")).limit(2 * sample + LENGTHS).select("embedding").collect()
    by_length: dict[int, list] = {c["d"]: [] for c in counts}
    for r in drawn:
        own = by_length[len(r[0])]
        if len(own) < each:
            own.append(r[0])
    return {d: _unit(v) for d, v in by_length.items() if len(v) >= FEW or (v and d == counts[0]["d"])}


def retrieved(classes: DataFrame, layout: Layout) -> DataFrame:
    """The candidate pairs of classes (cls, embedding): see near_codes(). A pair can come from two spaces. An entry's home is its cell, cut into chunks of about CHUNK."""
    coded = saved(classes.select("cls", "embedding").mapInArrow(_coded(layout), layout.schema), "codes")
    own = coded.where("own").select("cls", "cell")
    chunks = own.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    home = F.xxhash64("cell", F.pmod(F.xxhash64("cls"), F.col("chunks"))).alias("home")
    if any(len(s) > 1 for s in layout.spaces.values()):  # an entry has one home, in whatever space it is met
        coded = coded.drop("cell").join(own.join(chunks, "cell").select("cls", home), "cls")
    else:
        coded = coded.join(chunks, "cell").withColumn("home", home)
    pairs = near_codes(coded.where("turned = 0"), *layout.whole)
    return pairs.union(near_codes(coded.where("turned > 0"), *layout.split, layout.check, layout.threshold)) if layout.split else pairs


def linked(emb: DataFrame, vec: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: the vectors found with cosine >= threshold, copies included.

    Vectors that cannot link (null, empty, zero, or with a component that is null or not finite) have no links and are their own component. Vectors of
    different lengths never link; each length has codes of its own. Rows that repeat a vector or a whole row count one by one. Rows with a null vec_id take part, and get as
    component the least id that they reach. Long vectors are taken whole; other columns, whatever their names, are not read. A zero-row table gives no rows."""
    spark = emb.sparkSession
    every = emb.select("vec_id", F.col(vec).cast("array<double>").alias("embedding"))
    # -0.0 and 0.0 are equal here
    good = every.where(_fine()).select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"))
    classes = good.groupBy("embedding").agg(F.count("*").alias("size")).withColumn("cls", F.xxhash64("embedding"))
    classes = stored = saved(classes, "vectors")
    n = classes.count()
    if not n:
        return emb.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Unequal vectors of one hash (three pairs are to be expected among ten thousand million) are told apart by a second hash.
    twice = classes.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    if not twice.isEmpty():
        twice = saved(twice.withColumn("__twice", F.lit(True)), "twice")
        again = lambda d: d.join(F.broadcast(twice), "cls", "left").withColumn("cls", F.when(F.col("__twice"), F.xxhash64(F.lit(1), "embedding")).otherwise(F.col("cls"))).drop("__twice")
    else:
        again = lambda d: d
    classes = again(classes)
    member = again(good.withColumn("cls", F.xxhash64("embedding"))).select("vec_id", "cls")
    samples = _samples(classes, n, sample)
    layout = Layout({d: learned(x, threshold, SPACES // len(samples)) for d, x in samples.items()}, threshold)
    pairs = saved(retrieved(classes, layout), "pairs")
    # Jobs: the members of the pairs between two homes.
    turned = F.col("ahome") > F.col("bhome")
    first, second = F.least("ahome", "bhome").alias("ahome"), F.greatest("ahome", "bhome").alias("bhome")
    side = lambda own: F.when(F.col("ahome") == F.col("bhome"), 0).when(turned, 1 - own).otherwise(own)
    ends = F.array(F.struct(F.col("a").alias("cls"), side(0).alias("side")), F.struct(F.col("b").alias("cls"), side(1).alias("side")))
    asks = saved(pairs.select(first, second, F.explode(ends).alias("e")).select("ahome", "bhome", "e.cls", "e.side").distinct(), "jobs")
    jobs = asks.agg(F.approx_count_distinct(F.xxhash64("ahome", "bhome"))).first()[0]
    bundles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), jobs // JOBS_A_BUNDLE)
    work = asks.join(classes.select("cls", "size", "embedding"), "cls").withColumn("bundle", F.pmod(F.xxhash64("ahome", "bhome"), F.lit(bundles)))
    found = saved(work.groupBy("bundle").applyInPandas(_reranked(threshold), "cls long, links long, root long"), "links")
    tree = saved(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))), "tree").withColumnRenamed("node", "cls")
    direct = found.groupBy("cls").agg(F.sum("links").alias("links"))
    least = member.groupBy("cls").agg(F.min("vec_id").alias("first"))
    per = classes.select("cls", "size").join(least, "cls").join(direct, "cls", "left").join(tree, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = per.groupBy("root").agg(F.min("first").alias("component_id"))
    per = saved(per.join(lowest, "root").select("cls", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "per")
    for x in (pairs, asks, found, tree, stored):
        discard(x)
    inside = member.join(per, "cls").select("vec_id", "n_links", "component_id")
    outside = every.where(~_fine()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.union(outside).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

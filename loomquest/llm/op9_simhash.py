"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through multi-index hashing.

grouped() links fingerprints of whole texts at 2 bits. A fingerprint is two segments of 32 bits. Two fingerprints that differ in at most 2 bits differ in at
most one bit of some segment, so each fingerprint looks up the ball of radius 1 around either segment in that segment's table, and each match's
complete distance is verified. Equal fingerprints are one entry, so copies cost nothing.

deduped() links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Of 64 bits such fingerprints differ in up to 18, for which two segments
have no balls. So it takes wide fingerprints, by the same majority of all the text's shingles for each bit, and more segments: a bit of two such texts differs with
probability acos(8 / 9) / pi = 0.1515, a segment of w bits agrees with probability 0.8485 ** w, and there are as many segments as leave no pair of similarity 0.8 without a common one but
with probability 0.00001 (tables()). Each is looked up in its own table with a ball of radius 0. w follows the number of texts, so that a bucket holds BUCKET unrelated ones at most. A match's
Hamming distance is verified in the join on CHECKED further bits of the fingerprint. What passes is verified on the complete sets; parity prints
bound their similarity before: bit i of 512 says whether an odd number of the set's shingles hashes to i, so two sets differ in at least as many shingles as their prints in bits.

Versions of one text that are unlike by more than that share segments with each other all the same. Where texts crowd like this, those of which a good part is shingles that more than CROWD texts
have are looked up by their other shingles too (_crowded()), and the buckets leave out the pairs that this finds."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import ascii_lower, components, discard, saved, sealed, words

SHINGLE, MAX_BITS = 3, 2
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
#: Shingles turned into bits at a time: 64 bytes each.
CHUNK = 1 << 18
# The wide fingerprint: WIDTHS are the least and greatest segments, BUCKET the unrelated texts of one value of a segment.
WIDE_SHINGLE, PARITY, SEED, WIDTHS, BUCKET, MISSED = 5, 8, 13, (8, 16), 256, 1e-5
#: How often a bit of two texts of similarity 0.8 differs (a little more than it does), and the bits that are compared beside the segments: of 128 they differ in 19 (sd 4.1), unrelated texts in 64 (sd 5.7).
BIT_DIFFERS, CHECKED, CHECKED_DIFFER = 0.16, 128, 43
#: Segments by whose hubs large groups are found first; shingles whose wide bits are held at a time.
HUBS, SLICE = 16, 1 << 12
#: Classes of one segment in a block; a bucket of more than HOT is met block by block.
BLOCK, HOT = 512, 2048
#: A text that more than CROWD others are close to makes a crowd; a shingle of more than CROWD texts is common. The greatest reach is that of a text outside crowds.
CROWD, FAR = 64, 2**31 - 1
#: A table of keys is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST = 1_000_000
_RNG = np.random.default_rng(SEED)
_XOR, _TIMES = (_RNG.integers(0, 2**64, 64, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bits_over_half(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per document; hashes holds all documents' shingle hashes, counts their numbers."""
    ones = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK]).astype("<i8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who, start = np.unique(owner[at : at + CHUNK], return_index=True)
        ones[who] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    over = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<i8").ravel()


def _fingerprints(batches):
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = lists.offsets.to_numpy()
        hashes = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        prints = _bits_over_half(hashes, np.diff(offsets))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def _shingles(size: int) -> Column:
    """Hashes of the shingles of the words in __w; fewer words than a shingle are one shingle."""
    joined = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("__w", i + k) for k in range(size)]))
    return (
        F.when(F.size("__w") >= size, F.transform(F.sequence(F.lit(0), F.size("__w") - size), joined))
        .when(F.size("__w") > 0, F.array(F.xxhash64(F.array_join("__w", " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _split(text: str) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """keys and fp (long) per row. A text with fewer words than a shingle has one shingle, its whole sequence; one without words, or
    null, has fingerprint 0."""
    d = docs.select(*keys, _split(text).alias("__w")).select(*keys, _shingles(size).alias("__h"))
    return d.mapInArrow(_fingerprints, docs.select(*keys).withColumn("fp", F.lit(0).cast("long")).schema)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, that differ in at most max_bits bits. prints: one column fp, distinct.

    The radius of the balls is max_bits // SEGMENTS, which makes the lookup complete."""
    if max_bits // SEGMENTS > 1:
        raise ValueError("balls of radius 1 serve at most 3 bits in two segments")
    mask = (1 << WIDTH) - 1
    segment = lambda t: F.shiftrightunsigned("fp", t * WIDTH).bitwiseAND(F.lit(mask).cast("long"))
    both = F.array(*[F.struct(F.lit(t).alias("t"), segment(t).alias("key")) for t in range(SEGMENTS)])
    index = prints.select("fp", F.explode(both).alias("s")).select("s.t", "s.key", F.col("fp").alias("b"))
    flips = [0, *(1 << i for i in range(WIDTH))] if max_bits >= SEGMENTS else [0]
    ball = F.array(*[F.lit(x).cast("long") for x in flips])
    probe = prints.select("fp", F.explode(both).alias("s")).select("s.t", F.explode(F.transform(ball, lambda x: F.col("s.key").bitwiseXOR(x))).alias("key"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probe.join(index.hint("shuffle_hash"), ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """fp, first (least doc_id of the class), root (of its component), for each distinct fingerprint."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = saved(links(classes.select("fp"), max_bits), "near")
    tree = saved(components(found), "tree")
    discard(found)
    return classes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def grouped(docs: DataFrame, text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (long), component_id: one row per row of docs.

    component_id is the smallest doc_id whose fingerprint is reachable by links of at most max_bits bits; rows with a null doc_id take part in
    linking, but never name a component (null only if no row of the component has an id). Repeated rows are linked as equal prints and all stay; texts of any length are
    taken whole, null and empty ones have print zero; equal prints are one node however many texts have them; an empty table gives no rows. Other columns are not read."""
    prints = saved(fingerprints(docs, ["doc_id"], text, size), "prints")
    rooted = _rooted(prints, max_bits)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


# --- wide fingerprints ------------------------------------------------------------------------------------------------------------------


def tables(texts: int) -> tuple[int, int]:
    """Bits of a segment and number of segments for so many texts."""
    width = min(max(math.ceil(math.log2(max(1, texts) / BUCKET)), WIDTHS[0]), WIDTHS[1])
    return width, math.ceil(math.log(MISSED) / math.log1p(-((1 - BIT_DIFFERS) ** width)))


def _wide_bits(hashes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """One row of bits per text: 1 where over half of its shingles have it. hashes holds all texts' distinct shingle hashes, counts their numbers."""
    n_words = -(-bits // 64)
    ones, ends = np.zeros((len(counts), 64 * n_words), np.uint32), np.cumsum(counts)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        mixed = (part[:, None] ^ _XOR[:n_words]) * _TIMES[:n_words]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(32)
        seen = np.unpackbits(mixed.view(np.uint8), axis=1)
        first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
        for k in range(first, last + 1):
            a, b = max(0, ends[k] - counts[k] - at), min(len(part), ends[k] - at)
            for i in range(a, b, 255):
                ones[k] += np.add.reduce(seen[i : min(b, i + 255)], axis=0, dtype=np.uint8)
    return (2 * ones > counts[:, None])[:, :bits]


def _parity(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """PARITY rows of 64 bits, one column per text, from the distinct shingles of each."""
    out = np.zeros((PARITY, len(counts)), np.uint64)
    if len(hashes):
        some = np.flatnonzero(counts)
        start = (np.cumsum(counts) - counts)[some]
        word, bit = hashes >> np.uint64(6) & np.uint64(PARITY - 1), np.uint64(1) << (hashes & np.uint64(63))
        for k in range(PARITY):
            out[k, some] = np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), start)
    return out


def _wide(width: int, number: int):
    """Of each text its number of distinct shingles, parity print, the bits that are compared, and the segments, each with its place; about CHUNK shingles at a time."""
    powers, place = 1 << np.arange(width), np.arange(number) << WIDTHS[1]

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets = lists.offsets.to_numpy()
            hashes = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
                to = min(to, at + SLICE)
                own, counts, n = hashes[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1]).astype(np.int64), to - at
                bits, parity = _wide_bits(own, counts, CHECKED + width * number), _parity(own, counts)
                checked = np.packbits(bits[:, :CHECKED], axis=1).view("<i8").T
                segments = (bits[:, CHECKED:].reshape(n, number, width) @ powers + place).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * number), pa.array(segments.ravel()))
                longs = [pa.array(np.ascontiguousarray(p).view(np.int64)) for p in (*parity, *checked)]
                yield pa.RecordBatch.from_arrays([*[c[at:to] for c in batch.columns[:-1]], pa.array(counts), *longs, listed], names=[*batch.schema.names[:-1], *_PRINT, *_CHECKED, "segments"])
                at = to

    return run


_PRINT = ["n", *[f"p{k}" for k in range(PARITY)]]
_CHECKED = [f"f{k}" for k in range(CHECKED // 64)]


def _close(a: str, b: str) -> Column:
    """Whether two fingerprints differ in few enough of the bits that are compared."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{f}").bitwiseXOR(F.col(f"{b}{f}"))) for f in _CHECKED]) <= CHECKED_DIFFER


def _may_link(a: str, b: str) -> Column:
    """False only for pairs of classes below the similarity: sets of n and m shingles that differ in d have (n + m - d) / (n + m + d), and their parity prints
    differ in d bits at most."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(PARITY)])
    both = F.col(f"{a}n") + F.col(f"{b}n")
    return (9 * differ <= both) & _alike(a, b)


def _verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose complete shingle sets have a similarity of 0.8 or more."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    used = saved(used.join(classes.select("cls", F.col("best.id").alias("doc_id"), F.col("best.k").alias("__k")), "cls"), "used")
    few = used.count() <= BROADCAST
    rows = keyed.join(F.broadcast(used) if few else used, keyed["__k"].eqNullSafe(used["__k"]) & keyed["doc_id"].eqNullSafe(used["doc_id"])).select("cls", _split("text").alias("__w"))
    sets = saved(rows.select("cls", F.array_distinct(_shingles(WIDE_SHINGLE)).alias("s")).dropDuplicates(["cls"]), "sets")
    of = lambda c: sets.select(F.col("cls").alias(c), F.col("s").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = 5 * both >= 4 * (F.size("sa") + F.size("sb") - both)
    return saved(pairs.join(of("b"), "b").join(of("a"), "a").where(near).select("a", "b"), "near")


def _few(d: DataFrame) -> DataFrame:
    """d, broadcast where its measured size allows."""
    return F.broadcast(d) if d.count() <= BROADCAST else d


def _alike(a: str, b: str) -> Column:
    """Whether the numbers of shingles of two classes allow a similarity of 0.8."""
    return 5 * F.least(F.col(f"{a}n"), F.col(f"{b}n")) >= 4 * F.greatest(F.col(f"{a}n"), F.col(f"{b}n"))


def _crowded(classes: DataFrame, shingles: DataFrame) -> DataFrame:
    """cls, c, reach and rare of the classes with common shingles.

    A class of n shingles, c of them common, that is linked to one of m shares 4 / 9 * (n + m) of them with it; where that is more than c, that is for m > reach, they share one that is not common.
    In an order with these first, the first that they share is among the first n / 5 + 1 of either, so rare holds those (fewer, where the common ones begin). A class has a reach if a quarter of it is
    common, and is FAR-reaching otherwise; classes linked to one with a reach have at least 0.25 - 0.2 of its n in common shingles, 0.04 of their own."""
    common = saved(shingles.groupBy("s").agg(F.count("*").alias("size")).where(F.col("size") > CROWD).select("s", F.lit(1).alias("hit")), "common")
    held = shingles.join(_few(common), "s", "left").groupBy("cls", "check").agg(F.count("hit").alias("hit"), F.count("*").alias("seen")).where("hit > 0")
    held = held.join(classes.select("cls", "check", "n"), ["cls", "check"]).select("cls", "check", "n", F.expr("hit * n div seen").alias("c")).where("25 * c >= n")
    held = saved(held, "held")
    rare = shingles.join(_few(held.select("cls", "check")), ["cls", "check"], "left_semi").join(_few(common), "s", "left_anti")
    rare = rare.groupBy("cls").agg(F.sort_array(F.collect_set("s")).alias("rare"))
    reach = F.when(4 * F.col("c") >= F.col("n"), F.expr("9 * c div 4 - n")).otherwise(FAR).cast("int")
    found = held.join(rare, "cls", "left").select("cls", "c", reach.alias("reach"), F.slice("rare", 1, F.expr("int(n div 5 + 1)")).alias("rare"))
    found = saved(found, "crowded")
    for x in (common, held):
        discard(x)
    return found


def _near_groups(classes: DataFrame, keyed: DataFrame, shingles: DataFrame) -> DataFrame:
    """cls and root (of its group), for each class that has a link.

    First every class meets the least one of its buckets in HUBS tables, and in a crowd also the one with the most common shingles, which finds the large groups. Then in each table's buckets those
    of different groups meet, within their reach, and those beyond it by the shingles of _crowded(). In a hot bucket the classes outside its largest group meet all those of other groups, in blocks,
    so that a large group makes no pairs of its own and no bucket is one task's."""
    by_key = lambda d, *more: d.select(*more, "cls", *_CHECKED, F.explode("segments").alias("key"))
    name = lambda d, to, names, more=(): d.select(*more, F.col("cls").alias(to), *[F.col(c).alias(f"{to}{c}") for c in names])
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def near(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = saved(pairs.distinct(), "pairs")
        may = saved(met.join(name(classes, "a", _PRINT), "a").join(name(classes, "b", _PRINT), "b").where(_may_link("a", "b")).select("a", "b"), "pairs")
        return met, _verified(may, classes, keyed)

    some = by_key(classes.withColumn("segments", F.slice("segments", 1, HUBS)))
    hub = some.groupBy("key").agg(F.min_by(F.struct("cls", *_CHECKED), "cls").alias("x"), F.count("*").alias("size")).where("size > 1")
    hub = saved(name(hub.select("key", "x.*"), "a", _CHECKED, ["key"]), "hubs")
    first = saved(name(some, "b", _CHECKED, ["key"]).join(_few(hub), "key").where((F.col("a") < F.col("b")) & _close("a", "b")).select("a", "b"), "tried")
    crowded, to_hub = None, first
    if not first.groupBy("a").agg(F.count_distinct("b").alias("size")).where(F.col("size") > CROWD).isEmpty():
        crowded = _crowded(classes, shingles)
        inner = by_key(classes.join(crowded.where(F.col("reach") < FAR).select("cls", "c"), "cls").withColumn("segments", F.slice("segments", 1, HUBS)), (F.col("c") / F.col("n")).alias("share"))
        best = inner.groupBy("key").agg(F.max_by(F.struct("cls", *_CHECKED), F.struct("share", "cls")).alias("x")).select("key", "x.*")
        best = saved(name(best, "a", _CHECKED, ["key"]), "hubs")
        to_hub = first.union(name(inner, "b", _CHECKED, ["key"]).join(_few(best), "key").where((F.col("a") != F.col("b")) & _close("a", "b")).select(*ordered))
    tried, found = near(to_hub)
    tree = saved(components(found), "tree").withColumnRenamed("node", "cls")
    reach = classes.join(crowded.select("cls", "reach"), "cls", "left").withColumn("reach", F.coalesce("reach", F.lit(FAR))) if crowded is not None else classes.withColumn("reach", F.lit(FAR))
    rooted = reach.join(tree, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.col("n").cast("int").alias("n"), "reach", *_CHECKED, "segments")
    rooted = saved(rooted, "rooted")
    held = ["root", "n", "reach", *_CHECKED]
    rows = by_key(rooted.where("reach >= 0.8 * n"), "root", "n", "reach")
    hot = saved(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > HOT), "hot")
    # Neither side is renamed before the exchange, so that both read the same one.
    even = rows.join(_few(hot.select("key")), "key", "left_anti").repartition("key")
    apart = (F.col("aroot") != F.col("broot")) & _alike("a", "b") & _close("a", "b")
    within = apart & (F.col("an") <= F.col("breach")) & (F.col("bn") <= F.col("areach"))
    pairs = name(even, "a", held, ["key"]).join(name(even, "b", held, ["key"]), "key").where((F.col("a") < F.col("b")) & within).select("a", "b")
    if not hot.isEmpty():
        large = rows.join(_few(hot), "key")
        most = large.groupBy("key", "size", "root").agg(F.count("*").alias("n")).groupBy("key", "size").agg(F.max(F.struct("n", "root")).alias("most"))
        most = saved(most.select("key", F.col("most.root").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "most")
        large = rows.join(_few(most), "key")
        outside = name(large.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "a", held, ["key", "block"])
        all_of = name(large.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")), "b", held, ["key", "block"])
        pairs = pairs.union(outside.join(all_of, ["key", "block"]).where(within).select(*ordered))
    if crowded is not None:
        rare = rooted.join(crowded.select("cls", "rare"), "cls").select("cls", *held, F.posexplode("rare").alias("at", "s")).repartition("s")
        first_shared = lambda x: 9 * (F.col(f"{x}n") - F.col(f"{x}at")) >= 4 * (F.col("an") + F.col("bn"))
        beyond = apart & (F.col("bn") > F.col("areach")) & first_shared("a") & first_shared("b")
        pairs = pairs.union(name(rare, "a", [*held, "at"], ["s"]).join(name(rare, "b", [*held, "at"], ["s"]), "s").where(beyond).select(*ordered))
    more, again = near(pairs)
    tree = saved(components(found.union(again)), "tree").withColumnRenamed("node", "cls")
    for x in (hub, first, tried, found, rooted, more, again, hot, *([best, crowded] if crowded is not None else ())):
        discard(x)
    return tree


def deduped(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group linked by near copies (similarity 0.8 or more of the sets of five-word shingles, A-Z lower-cased) the row with the
    smallest doc_id; of rows that repeat that id, the one whose text hashes lowest, and of those that are equal in both the one whose columns do.

    Rows with a null doc_id come after all others. Texts with fewer than five words have one shingle, all their words; texts without words, and null ones, are one
    group. Long texts are taken whole. An empty table gives an empty table. Texts of equal 64-bit class hashes but unequal second hashes all stay."""
    keyed = docs.withColumn("__k", F.xxhash64(text))
    d = keyed.select("doc_id", "__k", _split(text).alias("__w"))
    whole = F.array_join("__w", " ")
    d = d.select("doc_id", "__k", F.xxhash64(whole).alias("cls"), F.xxhash64(F.lit(1), whole).alias("check"), F.array_distinct(_shingles(WIDE_SHINGLE)).alias("__h"))
    width, number = tables(docs.count())
    longs = "".join(f", {c} long" for c in ("__k", "cls", "check", *_PRINT, *_CHECKED))
    prints = saved(d.mapInArrow(_wide(width, number), f"doc_id {dict(docs.dtypes)['doc_id']}{longs}, segments array<int>"), "prints")
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__k").alias("k"))
    both = prints.groupBy("cls", "check").agg(F.min(best).alias("best"), *[F.first(c).alias(c) for c in (*_PRINT, *_CHECKED, "segments")])  # copies agree in these
    classes = saved(both.groupBy("cls").agg(F.min_by(F.struct("check", "best", *_PRINT, *_CHECKED, "segments"), "check").alias("x")).select("cls", "x.*"), "classes")
    unlike = prints.select("cls", "check", best.alias("best")).join(classes.select("cls", "check"), ["cls", "check"], "left_anti")
    shingles = sealed(d.select("cls", "check", "__h"), ["__h"]).select("cls", "check", F.explode("__h").alias("s"))
    rooted = _near_groups(classes, keyed.select("doc_id", "__k", F.col(text).alias("text")), shingles)
    keep = classes.join(rooted, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("best").alias("best")).select("best")
    keep = keep.union(unlike.select("best")).select(F.col("best.id").alias("__id"), F.col("best.k").alias("__hash")).distinct()
    # How often a kept row is there: only rows that repeat both id and text are counted out.
    copies = prints.groupBy(F.col("doc_id").alias("__id"), F.col("__k").alias("__hash")).agg(F.count("*").alias("__copies"))
    keep = saved(keep.join(copies, keep["__id"].eqNullSafe(copies["__id"]) & (keep["__hash"] == copies["__hash"])).select(keep["__id"], keep["__hash"], "__copies"), "keep")
    few = keep.count() <= BROADCAST
    kept = keyed.join(F.broadcast(keep) if few else keep, keyed["doc_id"].eqNullSafe(keep["__id"]) & (keyed["__k"] == keep["__hash"]))
    discard(prints)
    single = kept.where("__copies = 1").select(*docs.columns)
    if keep.where("__copies > 1").isEmpty():
        return single
    row = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    first = kept.where("__copies > 1").select("__id", "__hash", F.struct(*docs.columns).alias("__row"), row.alias("__tie")).groupBy("__id", "__hash").agg(F.min_by("__row", "__tie").alias("__row"))
    return single.union(first.select("__row.*"))

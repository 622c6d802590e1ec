"""Token-ID output: fixed-width bit packing with block offsets.

A file holds its blocks, the byte offset of every block (uint64) and a 32-byte end (magic, version, bits per id, ids per block, number of
ids, number of blocks), so it is written as a stream: each id in the least number of bits that the vocabulary needs, little-endian bit order, each
block padded to a whole byte. Any id is found from its number; numpy unpacks whole blocks at once. Beside the ids stands a
Parquet index with each document's first id and number of ids."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquest.llm.common import discard, saved

MAGIC, VERSION, BLOCK = b"LQTB", 2, 1 << 16
END = struct.Struct("<4sHHIQI8x")
END_ID = 2
#: Bytes of text that one file's range of doc_ids holds, about; files of a larger input grow rather than pass so many.
FILE_BYTES, MAX_FILES = 32 << 20, 20_000
#: Words kept in each of the two generations of a worker's cache, and characters of text encoded at a time.
CACHE, CHARS = 500_000, 4 << 20


# --- the format -------------------------------------------------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, little-endian bit order, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of data as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Writes one file to out, block by block; close() puts the block table behind them. Holds less than two blocks."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block, self.rest, self.open, self.n, self.at = out, bits, block, [], 0, 0, [0]

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.n += len(ids)
        self.open += len(ids)
        if self.open >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block * self.block
            for at in range(0, whole, self.block):
                self._put(flat[at : at + self.block])
            self.rest, self.open = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at.append(self.at[-1] + len(data))

    def close(self) -> None:
        if self.open:
            self._put(np.concatenate(self.rest))
        blocks = len(self.at) - 1
        self.out.write(np.array(self.at[:-1], "<u8").tobytes() + END.pack(MAGIC, VERSION, self.bits, self.block, self.n, blocks))


class Reader:
    """Random access to the ids of a file: ids(start, n) reads only the blocks that it needs."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, os.SEEK_END)
        file.seek(max(0, size - END.size))
        end = file.read(END.size)
        magic, version, self.bits, self.block, self.n, blocks = END.unpack(end) if len(end) == END.size else (None,) * 6
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a packed id file")
        file.seek(size - END.size - 8 * blocks)
        self.offsets = np.frombuffer(file.read(8 * blocks), "<u8")

    def ids(self, start: int, n: int) -> np.ndarray:
        if not 0 <= start <= start + n <= self.n:
            raise IndexError(f"ids {start} to {start + n} of {self.n}")
        if not n:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (start + n - 1) // self.block + 1
        held = min(self.n, b * self.block) - a * self.block
        self.file.seek(int(self.offsets[a]))
        per = -(-self.block * self.bits // 8)
        data = self.file.read((b - a - 1) * per + -(-(held - (b - a - 1) * self.block) * self.bits // 8))
        if self.block * self.bits % 8:  # blocks end on bytes
            flat = np.concatenate([unpack(data[i * per : (i + 1) * per], min(self.block, held - i * self.block), self.bits) for i in range(b - a)])
        else:
            flat = unpack(data, held, self.bits)
        return flat[start - a * self.block :][:n]


def _qualified(spark: SparkSession, path: str) -> str:
    """The URI that Hadoop takes the path for: one without a scheme lies on the default file system, for Spark's files and ours alike."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", uri)


# --- encoding ---------------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Marks of words for the whole tokenizer, and of a text's end; texts that hold these characters are for the whole tokenizer, so their words begin with the first.
_WHOLE, _END = "\ue000", "\ue001"


class Encoder:
    """Encodes whole texts word by word, each distinct word once while it is in the cache.

    Words are what stands between spaces and line ends of the lower-cased text. Most are letters alone, one piece of the tokenizer's own
    splitting pattern; the others are cut by that pattern; the model never looks across pieces, so this gives what encoding the whole text gives. Texts with characters from
    U+0250 on, which the normaliser may compose, or with a special token keep their words as they are, and the whole tokenizer encodes those. Two generations
    bound the cache: when the new one is full it becomes the old one, and what is still in use moves up."""

    def __init__(self, path: str, end_id: int | None = None, kind: str = "<u4", cache: int = CACHE):
        import regex

        self.tokenizer, self.end_id, self.kind, self.limit, self.new, self.old = _tokenizer(path), end_id, np.dtype(kind), cache, {}, {}
        self.model = self.tokenizer.model.tokenize
        self.code = {1: "B", 2: "H", 4: "I"}[self.kind.itemsize]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p["pattern"].get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", []) if p.get("type") == "Split" and p.get("invert")]
        lowers = [n for n in (spec.get("normalizer") or {}).get("normalizers", []) if n["type"] == "Lowercase"]
        self.pieces = regex.compile(splits[0], regex.V0).findall if len(splits) == 1 and lowers else None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.far = re.compile("[^\\x00-\u024f]").search

    def _odd(self, text: str) -> bool:
        return self.pieces is None or any(t in text for t in self.special) or not text.isascii() and self.far(text) is not None

    def _word(self, word: str) -> bytes:
        """By the model alone where that will do, which wants the bytes as the characters that stand for them."""
        model = self.model
        if word.isascii():
            ids = [t.id for t in model(word)] if word.isalpha() else [t.id for p in self.pieces(word) for t in model(p if p.isprintable() else p.translate(_BYTE_NAMES))]
        elif word[0] == _WHOLE:
            ids = self.tokenizer.encode(word[1:], add_special_tokens=False).ids
        elif word == _END:
            ids = [] if self.end_id is None else [self.end_id]
        else:
            ids = [t.id for p in self.pieces(word) for t in model(p.encode().decode("latin-1").translate(_BYTE_NAMES))]
        return array(self.code, ids).tobytes()

    def _cut(self, text: str) -> str:
        """The words of a text and its end, between spaces."""
        if self._odd(text):
            return f"{_WHOLE}{text.replace('\n', ' ').replace(' ', f' {_WHOLE}')} {_END}"
        return f"{text.lower().replace('\n', ' ')} {_END}"

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id behind it, and the places where texts end."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        lists = pc.split_pattern(pa.array([self._cut(t) for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        names, new, old, word = coded.dictionary.to_numpy(zero_copy_only=False), self.new, self.old, self._word
        for w in set(names).difference(new):
            e = old.get(w)
            new[w] = word(w) if e is None else e
        ids = pa.array(map(new.__getitem__, names), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[lists.offsets.to_numpy()]
        return np.frombuffer(ids.buffers()[2], self.kind, ends[-1] // self.kind.itemsize), ends[1:] // self.kind.itemsize


# Byte-level models name each byte by a character: printable ones of Latin-1 by themselves, the others by U+0100, U+0101, ... in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_encoders: dict[tuple, Encoder] = {}


def _kind(bits: int) -> str:
    """The integers that ids are exchanged as: just as wide as the file's where those are whole bytes."""
    return "<u2" if 8 < bits <= 16 else "<u1" if bits <= 8 else "<u4"


def _runs(texts: list[str]):
    """Bounds of runs of texts with about CHARS characters."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= CHARS:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encoded(path: str, end_id: int | None, bits: int, edges: np.ndarray, copies: np.ndarray):
    """doc_id, text, tie to doc_id, n, ids, file, tie. Files go by the range of doc_ids, null ids last; copies has the number of files of each range: more
    than one only where a single id has more text than a file should hold, and then its rows are dealt by their tie, equal rows in turn. What is dealt
    hangs on the rows of the partition alone and not on their order, so a repeated task deals alike."""
    names, kind = ["doc_id", "n", "ids", "file", "tie"], _kind(bits)
    base = np.cumsum(copies) - copies

    def run(batches):
        if (path, end_id, kind) not in _encoders:
            _encoders[path, end_id, kind] = Encoder(path, end_id, kind)
        encoder, seen = _encoders[path, end_id, kind], Counter()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            docs = batch.column(0)
            file = np.searchsorted(edges, docs.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            file[docs.is_null().to_numpy(zero_copy_only=False)] = len(edges) + 1
            many = copies[file]
            if many.max(initial=1) > 1:
                tie = batch.column(2).to_numpy()
                turn = np.zeros(len(file), np.int64)
                for i in np.flatnonzero(many > 1).tolist():
                    key = docs[i].as_py(), int(tie[i])
                    turn[i] = seen[key]
                    seen[key] += 1
                file = base[file] + (tie.astype(np.uint64) % many.astype(np.uint64) + turn.astype(np.uint64)).astype(np.int64) % many
            else:
                file = base[file]
            file = pa.array(file.astype(np.int32))
            for a, b in _runs(texts):
                ids, stops = encoder.encode(texts[a:b])
                at = np.concatenate([[0], stops])
                width = ids.dtype.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at * width), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([docs[a:b], pa.array(np.diff(at)), packed, file[a:b], batch.column(2)[a:b]], names=names)

    return run


def _written(folder: str, bits: int):
    """Writes the rows of a partition, which come in order, as one file, and yields where each document lies. The file gets its name only when
    it is whole, and a repeated task writes the same bytes."""

    def run(batches):
        from pyspark import TaskContext

        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                part = TaskContext.get().partitionId()
                name, made = f"{root}/ids-{part:06d}.bin", f"{root}/.ids-{part:06d}-{uuid.uuid4().hex}"
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(made)
                writer = Writer(out, bits)
            n = batch.column(1).to_numpy()
            data = batch.column(2).cast(pa.large_binary())
            off = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset)
            start = writer.n + np.cumsum(n) - n
            writer.add(np.frombuffer(data.buffers()[2], _kind(bits), int(off[-1] - off[0]) // np.dtype(_kind(bits)).itemsize, int(off[0])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(start), batch.column(1)], names=["part", "doc_id", "at", "n"])
        if writer is not None:
            writer.close()
            out.close()
            fs.move(made, name)

    return run


def _doc_ranges(docs: DataFrame, text: str, file_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of doc_id ranges that hold about file_bytes of text each, from a narrow exact histogram, and for each range (and the null ids, last)
    the number of its files: more than one where a single id has more than twice that."""
    from loomquest.llm.op3_shard import splitters

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    keyed = saved(docs.select(F.col("doc_id").cast("long").alias("key"), size.alias("size")), "sizes")
    lo, hi, total, none = keyed.agg(F.min("key"), F.max("key"), F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("size"))), F.lit(0))).first()
    file_bytes = max(file_bytes, (total + none) // MAX_FILES)
    files = lambda n: max(1, -(-n // file_bytes)) if n > 2 * file_bytes else 1
    if lo is None or (count := max(1, -(-total // file_bytes))) == 1:
        discard(keyed)
        return np.zeros(0, np.int64), np.array([1, files(none)], np.int64)
    goals = [total * i // count for i in range(1, count)]
    keys, _, below = splitters(keyed.where("key is not null"), goals, [file_bytes // 8] * len(goals), bounds=(lo, hi))
    at = dict(sorted(zip(keys, below, strict=True)))
    edges, held = list(at), np.diff([0, *at.values(), total]).tolist()
    # The goals inside an id with more than its share fall on it and on the next key, so it has a range of its own.
    discard(keyed)
    alone = [b - a == 1 for a, b in zip([lo, *edges], [*edges, hi + 1], strict=True)]
    return np.array(edges, np.int64), np.array([*[files(n) if one else 1 for n, one in zip(held, alone, strict=True)], files(none)], np.int64)
def write_ids(docs: DataFrame, path: str, tokenizer: str, text: str = "text", end_id: int | None = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes every text, appends end_id, and writes packed id files under path in ascending doc_id order (null ids last, repeated ids by text hash,
    or, where one id alone has more text than two files should hold, by file).

    Returns the index that is also written as path/index: doc_id, file number, first id in the file, number of ids, and start (ids
    of all documents before it). Texts are encoded where they are read; only ids are exchanged, once. Null and empty texts have
    the end id alone; a long text is encoded whole, like any other. No rows: an empty index and no files. Other columns, whatever their names, are not read."""
    spark = docs.sparkSession
    bits = bits_for(_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))
    docs = docs.select("doc_id", F.col(text).alias("text"))
    edges, copies = _doc_ranges(docs, "text", file_bytes)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    packed = keyed.mapInArrow(_encoded(tokenizer, end_id, bits, edges, copies), "doc_id long, n long, ids binary, file int, tie long")
    placed = packed.repartitionById(int(copies.sum()), F.col("file")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tie")
    files = placed.select("doc_id", "n", "ids").mapInArrow(_written(_qualified(spark, f"{path}/ids"), bits), "part int, doc_id long, at long, n long")
    index = f"{path}/index"
    files.write.parquet(index)
    index = spark.read.schema(files.schema).parquet(index)
    totals = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a file, MAX_FILES at most but for those of ids of their own
    before, at = {}, 0
    for part in sorted(totals):
        before[part], at = at, at + totals[part]
    starts = spark.createDataFrame([(p, b) for p, b in before.items()], "part int, before long")
    return index.join(F.broadcast(starts), "part").select("doc_id", "part", "at", "n", (F.col("before") + F.col("at")).alias("start"))


def read_ids(index: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """index (of write_ids) with each document's ids read back from the files: ids_crc32, the crc32 of its ids as little-endian uint32, and, if asked for, ids.

    A task reads the documents of few files in order, and unpacks whole runs of blocks."""
    folder = _qualified(index.sparkSession, f"{path}/ids")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        reader, held = None, None
        for batch in batches:
            part, at, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            ids, sums = [], []
            for p, a, k in zip(part.tolist(), at.tolist(), n.tolist(), strict=True):
                if p != held:
                    reader, held = Reader(fs.open_input_file(f"{root}/ids-{p:06d}.bin")), p
                    window, base = np.zeros(0, "<u4"), 0
                if not base <= a <= a + k <= base + len(window):
                    base, size = a, min(reader.n - a, max(k, 4 * BLOCK))
                    window = reader.ids(a, size).astype("<u4", copy=False)
                own = window[a - base : a - base + k]
                ids += [own] if with_ids else []
                sums.append(zlib.crc32(own))
            if not with_ids:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "ids_crc32"])
                continue
            for i in range(0, len(ids), 500):
                lengths = np.cumsum([0, *map(len, ids[i : i + 500])])
                flat = np.concatenate(ids[i : i + 500]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[c[i : i + 500] for c in batch.columns], pa.array(sums[i : i + 500], pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int32()))], names=[*batch.schema.names, "ids_crc32", "ids"])

    return index.select("doc_id", "part", "at", "n", "start").mapInArrow(run, "doc_id long, part int, at long, n long, start long, ids_crc32 long" + ", ids array<int>" * with_ids)

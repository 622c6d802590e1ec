"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A pre-token is a stretch of text between two characters that no piece of the model holds side by side. Merges never reach over such a place, so a text has as many tokens as its
pre-tokens together, and no ids of a text are ever made. A first pass over all texts counts the distinct pre-tokens, whose pieces are then counted, each once. A second pass
makes the frequencies of each document. Pre-tokens that make up at least one part in SHARES of all occurrences, at most SHARES of them therefore and LONG bytes each, are
joined to the frequencies by a broadcast; all others go through a shuffle join, where no key can hold more than that one part of the rows.
Pre-tokens of more than LONG bytes (long runs of one character, say) stay out of both tables: they are counted where they stand, once in each run of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import saved

SPACE = "▁"
#: The broadcast pre-tokens are at most so many, of at most so many bytes each: 64 MB at the very most.
SHARES, LONG = 1 << 20, 64
#: Bytes of text in a run, about.
RUN_BYTES = 8 << 20
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class PieceCounter:
    """A sentencepiece model of the BPE kind with bytes for unknown characters. Models that normalise texts, move white space or hold pieces of a user's own are refused."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("the model normalises texts or moves white space, which is not handled")
        if trained.model_type != 2 or not trained.byte_fallback or any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in proto.pieces):
            raise ValueError("only BPE models with byte fallback and without pieces of a user's own are handled")
        self.prefix, norm.add_dummy_prefix = norm.add_dummy_prefix, False
        self.model = SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = [p.piece for p in proto.pieces if p.type == _NORMAL]
        if any(SPACE in p.lstrip(SPACE) or "\0" in p for p in pieces):
            raise ValueError("a piece reaches over the start of a word, which is not handled")
        pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        letters = sorted({c for x in pairs for c in x})
        #: A number for each character that stands beside another one in a piece (else 0), and whether two numbers do so.
        self.number, self.n = np.zeros(0x110000, np.int32), len(letters) + 1
        self.number[[ord(c) for c in letters]] = np.arange(1, self.n)
        self.joined = np.zeros(self.n * self.n, bool)
        for a, b in pairs:
            self.joined[self.number[ord(a)] * self.n + self.number[ord(b)]] = True

    def count(self, units: pa.Array) -> np.ndarray:
        """The number of pieces of each pre-token."""
        return np.fromiter(map(len, self.model.encode(units.to_pylist(), num_threads=1)), np.int64, len(units))

    def words(self, texts: pa.Array):
        """The texts (large strings) cut before the spaces that follow another character: distinct words, the word of each occurrence, and its text. Zero bytes, which no
        piece holds, cut too and belong to no word."""
        if self.prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), texts, pa.scalar("", pa.large_string())))
        cut = pc.replace_substring(pc.replace_substring(texts, " ", SPACE), SPACE, "\0" + SPACE)
        for _ in range(2):  # spaces in a row stay together; the second pass takes every other one
            cut = pc.replace_substring(cut, f"{SPACE}\0{SPACE}", SPACE + SPACE)
        lists = pc.split_pattern(cut, "\0")
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))

    def parts(self, words: pa.Array):
        """The distinct pre-tokens of distinct words, the pre-token of each place, and its word."""
        size = pc.binary_length(words).to_numpy()
        data = "".join(words.to_pylist()).encode()
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        number = self.number[points]
        begins = np.zeros(len(data) + 1, bool)
        begins[np.cumsum(size)[:-1]] = True  # a word's first character, that of an empty one included
        at = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        at = np.concatenate([[0], at[:-1]]) if len(points) else at
        cut = begins[at]
        cut[1:] |= ~self.joined[number[:-1] * self.n + number[1:]]
        cut[:1] = True
        starts = at[cut]
        own = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        return own.dictionary, own.indices.to_numpy(), np.searchsorted(np.cumsum(size), starts, side="right")


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _runs(batch: pa.RecordBatch):
    """(rows, their texts as large strings without nulls) in runs of about RUN_BYTES."""
    texts = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.large_string()), "")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def vocabulary(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """One row (unit, n, pieces) for each distinct pre-token of at most LONG bytes: its occurrences in all texts and its pieces, counted once. Written to the shared folder.
    Null and empty texts add nothing."""

    def units(batches):
        c = counter(model)
        for batch in batches:
            for _, texts in _runs(batch):
                words, of, _ = c.words(texts)
                names, part, owner = c.parts(words)
                n = np.bincount(part, np.bincount(of, minlength=len(words))[owner], len(names)).astype(np.int64)
                short = pa.array(pc.binary_length(names).to_numpy() <= LONG)
                yield pa.RecordBatch.from_arrays([names.filter(short).cast(pa.string()), pa.array(n).filter(short)], names=["unit", "n"])

    def pieces(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counter(model).count(b.column(0)))], names=["unit", "n", "pieces"])

    found = docs.select(text).mapInArrow(units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return saved(found.mapInArrow(pieces, "unit string, n long, pieces long"), "units")


def _frequencies(model: str, common):
    """Of each run of rows (keys, hash of the text, text): a row for each document, with the tokens of its broadcast and long pre-tokens, and one for each other
    pre-token that it holds, with its frequency. The unit of a document's own row is one that no text holds, another for each."""

    def run(batches):
        c, (units, pieces) = counter(model), common.value
        for batch in batches:
            for rows, texts in _runs(batch):
                words, of, doc = c.words(texts)
                names, part, owner = c.parts(words)
                place = pc.index_in(names, units)
                rare, known = place.is_null().to_numpy(zero_copy_only=False), np.zeros(len(names), np.int64)
                known[~rare] = pieces[place.drop_null().to_numpy()]
                long = pc.binary_length(names).to_numpy() > LONG
                known[long] = c.count(names.filter(pa.array(long)))
                rare &= ~long
                tokens = np.bincount(doc, np.bincount(owner, known[part], len(words))[of], len(rows)).astype(np.int64) + pc.count_substring(texts, "\0").to_numpy()
                # Words with rare pre-tokens, once per document; then those pre-tokens, once per document.
                mine = np.flatnonzero(rare[part])
                first, many = np.searchsorted(owner[mine], np.arange(len(words))), np.bincount(owner[mine], minlength=len(words))
                pair, times = np.unique((doc * len(words) + of)[many[of] > 0], return_counts=True)
                d, w = np.divmod(pair, max(1, len(words)))
                fan = many[w]
                step = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                whole, back = np.unique(np.repeat(d, fan) * len(names) + part[mine[np.repeat(first[w], fan) + step]], return_inverse=True)
                n = np.bincount(back, np.repeat(times, fan), len(whole)).astype(np.int64)
                d, p = np.divmod(whole, max(1, len(names)))
                none, at = np.zeros(len(whole), np.int64), pa.array(np.concatenate([np.arange(len(rows)), d]))
                own = pa.array([f"\n{h:x}" for h in rows.column(rows.num_columns - 2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[x.take(at) for x in rows.columns[:-1]],
                        pa.concat_arrays([own, names.take(pa.array(p)).cast(pa.string())]),
                        pa.array(np.concatenate([np.zeros(len(rows), np.int64), n])),
                        pa.array(np.concatenate([tokens, none])),
                        pa.array(np.concatenate([pc.binary_length(texts).to_numpy(), none])),
                        pa.array(np.concatenate([np.ones(len(rows), np.int64), none])),
                    ],
                    names=[*rows.schema.names[:-1], "__unit", "__n", "__tokens", "__bytes", "__rows"],
                )

    return run


def counted(docs: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_bytes (of the UTF-8 text) and n_tokens (of the model, without begin or end), both long, for each row.

    Null and empty texts have no bytes and no tokens. Texts of any length are taken whole. Strings of control pieces inside texts are text. Rows with the same keys and text count
    alike and all stay; null keys are keys like any other; an empty table gives none. Other columns are not read; n_bytes and n_tokens may not be keys."""
    spark = docs.sparkSession
    units = vocabulary(docs, model, text)
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * F.lit(SHARES) >= F.lit(total)
    known = units.where(frequent).select("unit", "pieces").toArrow()
    common = spark.sparkContext.broadcast((known["unit"].combine_chunks().cast(pa.large_string()), known["pieces"].to_numpy()))
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    d = docs.select(*named, F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("__text").schema)
    each = d.mapInArrow(_frequencies(model, common), f"{head}, __unit string, __n long, __tokens long, __bytes long, __rows long")
    others = units.where(~frequent).select(F.col("unit").alias("__unit"), "pieces")
    met = F.when(F.col("__n") == 0, F.lit(0)).otherwise(F.col("__n") * F.coalesce("pieces", F.raise_error(F.lit("a pre-token without a count")).cast("long")))
    per = each.join(others, "__unit", "left").groupBy(*d.drop("__text").columns).agg(F.sum(met + F.col("__tokens")).alias("__tokens"), F.sum("__bytes").alias("__bytes"), F.sum("__rows").alias("__rows"))
    share = lambda c: F.expr(f"`{c}` div `__rows`")
    out = per.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__rows"))))
    return out.select(*[F.col(f"__key{i}").alias(k) for i, k in enumerate(keys)], share("__bytes").alias("n_bytes"), share("__tokens").alias("n_tokens"))

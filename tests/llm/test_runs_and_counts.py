"""Periodic runs and token counts against brute force."""

import hashlib
import random

import plain
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from loomquest.llm import op11_runs, op12_counts, queries

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module", params=["small", "awkward", "empty"])
def case(request, spark):
    if request.param == "small":
        df = spark.read.parquet(f"{plain.SF}/documents.parquet")
        return [tuple(r) for r in df.collect()], df
    rows = plain.awkward() if request.param == "awkward" else []
    return rows, spark.createDataFrame(rows, plain.EXTRA).repartition(3).cache()


def keyed(rows):
    return sorted(map(tuple, rows), key=repr)


def sequences(n, seed):
    """Random sequences into which periods and copies were put."""
    r = random.Random(seed)
    for _ in range(n):
        w = [r.randrange(r.choice([2, 3, 5, 50])) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(4)) if len(w) > 4 else ():
            a, p = r.randrange(len(w)), r.randrange(1, max(2, len(w) // 4))
            for i in range(a, r.randrange(a, len(w) + 1)):
                w[i] = w[a + (i - a) % p]
            if r.random() < 0.5:
                size = r.randrange(len(w) // 2)
                a, b = r.randrange(len(w) - size), r.randrange(len(w) - size)
                w[b : b + size] = w[a : a + size]
        yield w


def test_runs_of_random_sequences():
    cases = [*sequences(3000, 5), [0] * 500, [0, 1] * 300, list(range(400)) * 2, [*range(50), *range(40)], []]
    assert all(op11_runs.runs_of(w) == plain.runs(w) for w in cases)
    for k in range(0, len(cases), 250):  # through the stretches of a batch
        lists = pa.array([list(map(str, w)) for w in cases[k : k + 250]], pa.list_(pa.string()))
        got = op11_runs._batch([], lists, []).to_pylist()
        assert [[tuple(x.values()) for x in g["runs"]] for g in got] == [plain.runs(w) for w in cases[k : k + 250]]


def test_factors_are_those_of_lempel_and_ziv():
    for w in sequences(300, 8):
        at = 0
        for b, e, source in op11_runs.factors(w):
            assert b == at and (source < 0) == (w[b] not in w[:b])
            if source >= 0:
                assert source < b and w[source : source + e - b] == w[b:e]
                assert e == len(w) or not any(w[s : s + e + 1 - b] == w[b : e + 1] for s in range(b))
            at = e
        assert at == len(w)


def test_runs(case):
    rows, df = case
    got = keyed((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in op11_runs.found(df, ["doc_id"]).collect())
    assert got == keyed((r[0], len(plain.split(r[1])), plain.runs(plain.split(r[1])), plain.collapsed(plain.split(r[1]))) for r in rows)


def test_runs_query_over_awkward_rows(spark, tmp_path):
    rows = [r for r in plain.awkward() if r[0] is not None][:-1]
    spark.createDataFrame(rows, plain.EXTRA).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect():
        w = plain.planted(r.doc_id, next(x[1] for x in rows if x[0] == r.doc_id))
        runs = plain.runs(w)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert r.exponent_milli == (1000 * r.length // r.period if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain.collapsed(w).encode()).hexdigest()


@pytest.mark.parametrize("shares", [op12_counts.SHARES, 100, 1])
def test_counts(case, shares, monkeypatch):
    """With all pre-tokens, some and next to none of them in the broadcast."""
    monkeypatch.setattr(op12_counts, "SHARES", shares)
    rows, df = case
    model = SentencePieceProcessor(model_file=MODEL)
    got = keyed(op12_counts.counted(df, MODEL, ["doc_id"]).collect())
    assert got == keyed((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows)


def test_counts_of_random_texts(spark, monkeypatch):
    monkeypatch.setattr(op12_counts, "SHARES", 50)
    r, model = random.Random(4), SentencePieceProcessor(model_file=MODEL)
    texts = ["".join(r.choice(" \n\0▁ab.é🙂<s></s><unk>=0\t\r漢 ﻿xyz  ") for _ in range(r.randrange(60))) for _ in range(4000)] + ["=" * 5000, "ab" * 3000, " " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: x.n_tokens for x in op12_counts.counted(df, MODEL, ["id"]).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_counts_keep_repeated_rows_and_keys(spark):
    df = spark.createDataFrame([(1, "x", "a b"), (1, "x", "a b"), (1, None, "a b c"), (None, None, None)], "a long, `key.b` string, text string").withColumnRenamed("key.b", "b")
    got = keyed(op12_counts.counted(df, MODEL, ["b", "a"]).select("a", "b", "n_bytes", "n_tokens").collect())
    assert got == keyed([(1, "x", 3, 2), (1, "x", 3, 2), (1, None, 5, 3), (None, None, 0, 0)])


def test_vocabulary_counts_each_unit_once(spark):
    df = spark.createDataFrame([("to be or not to be",), ("be",), (None,)], "text string").repartition(3)
    got = {r.unit: (r.n, r.pieces) for r in op12_counts.vocabulary(df, MODEL).collect()}
    assert got["▁be"] == (3, 1) and got["▁to"] == (2, 1) and sum(n for n, _ in got.values()) == 7

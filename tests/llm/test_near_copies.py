"""Wide fingerprints against brute force over planted near copies."""

import random

import numpy as np
import plain
import pytest

import corpus_pipeline
from loomquest.llm import op9_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(n=60, seed=5):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts = []
    for _ in range(n):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4):  # up to 20 of 116 shingles: similarities on both sides of 0.8
            w = list(base)
            for i in rnd.sample(range(120), changes):
                w[i] = word()
            texts.append(" ".join(w))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_planted_near_copies(spark):
    rows = planted()
    rows += [(None, rows[0][1], "en", "s", 1), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "two words", "en", "s", 9), rows[3]]
    want = plain.first_of_each(rows, plain.near_groups(rows))
    assert len(want) < 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert kept(corpus_pipeline.near_dedup(spark, df, "")) == want


@pytest.mark.parametrize("block", [3, 512])
def test_a_chain_of_near_copies(spark, monkeypatch, block):
    """One large group whose ends are unlike, and texts beside it that share shingles with many and are near to none: blocks of a segment change nothing."""
    monkeypatch.setattr(op9_simhash, "BLOCK", block)
    rnd = random.Random(9)
    w, texts = [f"c{i}" for i in range(100)], []
    for i in range(120):
        w = list(w)
        w[rnd.randrange(100)] = f"x{i}"
        texts.append(" ".join(w))
        if i % 4 == 0:  # five words changed, far apart
            far = list(w)
            for k in range(5):
                far[20 * k + rnd.randrange(10)] = f"y{i}{k}"
            texts.append(" ".join(far))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(rnd.sample(texts, len(texts)))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert kept(op9_simhash.deduped(df)) == plain.first_of_each(rows, plain.near_groups(rows))


def test_rows_of_one_hash_all_stay(spark, monkeypatch):
    """Of rows that repeat id and text one stays; clashing names of further columns do no harm."""
    rows = [(1, "a b c d e f g", "p", 1), (1, "a b c d e f g", "q", 2), (2, "A b C d e f g", "r", 3), (3, "other words stand here now", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, n int")
    assert sorted((r.doc_id, r.n) for r in op9_simhash.deduped(df).collect()) in ([(1, 1), (3, 4)], [(1, 2), (3, 4)])


def test_wide_fingerprints_are_of_whole_texts():
    """Every bit is the majority of all shingles, as in the narrow fingerprint, not of a few that are drawn."""
    rng = np.random.default_rng(2)
    counts = np.array([300, 0, 1, 5000, 8])
    hashes = rng.integers(0, 2**64, counts.sum(), np.uint64)
    got = op9_simhash._wide_bits(hashes, counts, 128 + 60 * 10)
    for row, own in zip(got, np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
        ones = np.zeros(768, int)
        for h in own.tolist():
            for k, (x, times) in enumerate(zip(op9_simhash._XOR[:12].tolist(), op9_simhash._TIMES[:12].tolist(), strict=True)):
                m = (h ^ x) * times % 2**64
                m = (m ^ m >> 32) * int(op9_simhash._MIX) % 2**64
                m ^= m >> 32
                ones[64 * k : 64 * k + 64] += np.unpackbits(np.frombuffer(m.to_bytes(8, "little"), np.uint8))
        assert (row == (2 * ones > len(own))[:728]).all()


@pytest.mark.parametrize("texts", [200, 200_000, 10_000_000])
def test_segments_leave_no_pair_of_similarity_08(texts):
    rng, (width, number) = np.random.default_rng(3), op9_simhash.tables(texts)
    for n, both in ((9, 8), (90, 80), (45, 40)):
        sets = []
        for _ in range(300):
            shared = rng.integers(0, 2**64, both, np.uint64)
            sets += [shared, rng.integers(0, 2**64, n - both, np.uint64), shared, rng.integers(0, 2**64, n - both, np.uint64)]
        bits = op9_simhash._wide_bits(np.concatenate(sets), np.full(600, n), op9_simhash.CHECKED + width * number)
        differ = bits[::2] != bits[1::2]
        assert differ[:, : op9_simhash.CHECKED].sum(axis=1).max() <= op9_simhash.CHECKED_DIFFER
        assert not differ[:, op9_simhash.CHECKED :].reshape(300, number, width).any(axis=2).all(axis=1).any()


@pytest.mark.parametrize("hot, broadcast", [(3, 1_000_000), (3, 0), (2048, 0)])
def test_hot_buckets_lose_no_link(spark, monkeypatch, hot, broadcast):
    monkeypatch.setattr(op9_simhash, "HOT", hot)
    monkeypatch.setattr(op9_simhash, "BLOCK", 3)
    monkeypatch.setattr(op9_simhash, "HUBS", 1)
    monkeypatch.setattr(op9_simhash, "BROADCAST", broadcast)
    rows = planted(20, 8)
    assert kept(op9_simhash.deduped(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain.first_of_each(rows, plain.near_groups(rows))


def versions(n, seed=11, words=120):
    """n versions of one text, with 0 to 24 words replaced, left out or put in; some are further versions of a version."""
    rnd = random.Random(seed)
    base, texts = [f"b{i}" for i in range(words)], []
    for i in range(n):
        w = list(rnd.choice(texts)) if texts and i % 10 == 0 else list(base)
        for _ in range(rnd.randrange(25) if i % 10 else 1):
            at, new = rnd.randrange(len(w)), f"n{rnd.randrange(200)}"
            w[at : at + 1] = rnd.choice([[new], [new], [], [w[at], new]])
        texts.append(w)
    return [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rnd.sample(texts, n))]


@pytest.mark.parametrize("crowd, hot, broadcast", [(64, 2048, 1_000_000), (3, 2048, 1_000_000), (64, 3, 0), (0, 2048, 1_000_000)])
def test_crowds_lose_no_link(spark, monkeypatch, crowd, hot, broadcast):
    monkeypatch.setattr(op9_simhash, "CROWD", crowd)
    monkeypatch.setattr(op9_simhash, "HOT", hot)
    monkeypatch.setattr(op9_simhash, "BROADCAST", broadcast)
    rows = versions(300) + [(i + 1000, t, *x) for i, t, *x in planted(10, 6)] + [(2000, "", "en", "s", 0), (2001, "b1 b2", "en", "s", 0), (2002, None, "en", "s", 0)]
    rows += [(i + 3000, t, *x) for i, t, *x in rows[:40]]
    want = plain.first_of_each(rows, plain.near_groups(rows))
    assert 100 < len(want) < 320
    assert kept(op9_simhash.deduped(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_pairs_of_a_crowd_grow_with_its_texts(spark, monkeypatch):
    """Versions of one text that are unlike by more than 0.8 are not all paired: before, twice the versions made four times the pairs."""
    made, saved = [], op9_simhash.saved

    def counted(df, name):
        out = saved(df, name)
        made.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(op9_simhash, "saved", counted)
    counts = []
    for n in (400, 800):
        made.clear()
        op9_simhash.deduped(spark.createDataFrame(versions(n), SCHEMA).repartition(3)).count()
        counts.append(sum(made))
    assert counts[1] < 2.5 * counts[0] and counts[1] < 40 * 800, counts

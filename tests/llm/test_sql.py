"""The operators' queries against their SQL, over the smallest tables."""

import os
import re
import struct
import zlib

import plain
import pytest

from loomquest.llm import op1_pii, queries


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in os.listdir(plain.SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{plain.SF}/{t}'")
    return con


def cells(rows):
    return sorted((tuple(None if x is None else round(float(x), 6) if isinstance(x, float) else str(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_sql_agree(spark, duck, name):
    df = queries.QUERIES[name](spark, plain.SF)
    columns = sorted(df.columns)
    got = cells(df.select(*columns).collect())
    result = duck.execute(queries.ORACLE_SQL[name])
    place = [d[0] for d in result.description]
    assert sorted(place) == columns and got == cells([[r[place.index(c)] for c in columns] for r in result.fetchall()])


# --- queries that SQL cannot state: every column against plain Python -----------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{plain.SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_by_id(spark, name, sf_dir=plain.SF):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def added_spans(text, base):
    """What the generators find and the trees keep, span by span."""
    trees, limits = op1_pii.model()

    def value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    for kind, (pattern, gate) in op1_pii.MORE.items():
        for m in re.finditer(pattern, text) if re.search(gate, text) else ():
            row = op1_pii.features_of(kind, m.group(), text[max(0, m.start() - op1_pii.BEFORE) : m.start()])
            if sum(value(t, row) for t in trees) >= limits[kind] and not any(a < m.end() and m.start() < b for a, b in base):
                yield f"{kind}:{m.start()}:{m.end()}"


def test_op1(spark, docs, tmp_path):
    """The table's texts, and texts in which real forms and look-alikes stand side by side."""
    examples = [f"{before}{found}" for _, found, before in op1_pii.examples(400, seed=77)[0]]
    rows = docs + [(10_000 + k, sep.join(examples[k * 20 : k * 20 + 20])) for k in range(20) for sep in (["; "], [" a@b.co "], ["\n+1 578 555 6437 é "])[k % 3]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_by_id(spark, "op1_pii_boosting", str(tmp_path))
    n_added = 0
    for i, text in rows:
        counts, sha, shown = plain.pii(text)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*counts.values(), sha)
        base = [tuple(map(int, x.split(":")[1:])) for x in shown.split(",") if x]
        added = list(added_spans(text or "", base))
        n_added += len(added)
        assert r.spans == ",".join([x for x in shown.split(",") if x] + added)
    assert n_added > 100


def test_op3(spark, docs):
    got = rows_by_id(spark, "op3_histogram_sort")
    shards = {}
    for i, text in docs:
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len((text or "").encode()) + 8, plain.crc(text), "bytes", None) and 0 <= r.shard < 24
        shards.setdefault(r.shard, []).append(r)
    assert len(shards) == 24 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    total, largest = sum(r.size for r in got.values()), max(r.size for r in got.values())
    assert all(abs(sum(r.size for r in v) - total / 24) <= largest + 0.002 * total / 24 for v in shards.values())
    again = rows_by_id(spark, "op3_histogram_sort")
    assert {i: (r.shard, r.slot) for i, r in again.items()} == {i: (r.shard, r.slot) for i, r in got.items()}


def test_op6(spark, docs, tmp_path):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = [(i, t) for i, t in docs if len(t or "") < 1200][:40] + [(10_000 + k, r[1]) for k, r in enumerate(plain.awkward()) if len(r[1] or "") < 300]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_by_id(spark, "op6_nbest_pieces", str(tmp_path))
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    for i, text in rows:
        r, want = got[i], plain.nbest(text, path)
        assert r.score == pytest.approx(want[0][0]) and list(r.nbest) == pytest.approx([w[0] for w in want[:4]], abs=1e-6) and r.exact
        assert r.ids_crc32 == r.nbest_crc32[0] and len(r.nbest_crc32) == len(r.nbest)
        for k, (s, ids) in enumerate(want[:4]):
            if all(abs(s - x) > 1e-6 for j, (x, _) in enumerate(want) if j != k):
                assert r.nbest_crc32[k] == crc(ids) and (k or r.n_pieces == len(ids))


def test_op9(spark, docs):
    got = rows_by_id(spark, "op9_simhash_mih")
    prints, groups, _ = plain.simhash_groups(docs)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", g) for (i, _), p, g in zip(docs, prints, groups, strict=True)}


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    got = rows_by_id(spark, "op10_packed_ids")
    for i, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_op12(spark, docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = rows_by_id(spark, "op12_token_counts")
    for i, text in docs:
        n = len(model.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 4096)


def test_every_query_is_stated_or_tested():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"op1_pii_boosting", "op3_histogram_sort", "op6_nbest_pieces", "op9_simhash_mih", "op10_packed_ids", "op12_token_counts"}

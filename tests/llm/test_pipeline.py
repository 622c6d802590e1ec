"""The pipeline against plain versions of its stages."""

import math
import zlib

import plain
import pytest
from test_sql import added_spans

import corpus_pipeline
from loomquest.llm import op1_pii, op6_pieces, queries
from loomquest.llm.common import saved


@pytest.fixture(scope="module", params=["small", "awkward", "empty"])
def case(request, spark, tmp_path_factory):
    if request.param == "small":
        return [tuple(r) for r in spark.read.parquet(f"{plain.SF}/documents.parquet").collect()], plain.SF
    rows = plain.awkward() if request.param == "awkward" else []
    path = str(tmp_path_factory.mktemp(request.param))
    spark.createDataFrame(rows, plain.EXTRA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows, path


def all_spans(text):
    """Base spans and those that the trees add: (start, end, kind)."""
    base = [x.split(":") for x in plain.pii(text)[2].split(",") if x]
    found = [(int(a), int(b), k) for k, a, b in base]
    return found + [(int(a), int(b), k) for k, a, b in (x.split(":") for x in added_spans(text, [(a, b) for a, b, _ in found]))]


def test_stages(case, spark):
    rows, sf_dir = case
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "pii", "mix", "encode"]
    good = [r for r in rows if not plain.quality(r[1])[5]]
    a = stages["quality"](spark, docs, sf_dir)
    assert a.columns == docs.columns and sorted(a.collect(), key=repr) == sorted(good, key=repr)
    b = stages["near_dedup"](spark, a, sf_dir)
    assert b.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in b.collect()) == plain.first_of_each(good, plain.near_groups(good))
    kept = {r.doc_id: r for r in b.collect()}
    c = stages["pii"](spark, b, sf_dir)
    clean = {r.doc_id: r for r in c.collect()}
    assert c.columns == docs.columns and clean.keys() == kept.keys()
    for i, r in clean.items():
        want = plain.redacted(kept[i].text, all_spans(kept[i].text))
        assert r.text == want and r.n_chars == len(want) and tuple(r)[2:4] + tuple(r)[5:] == tuple(kept[i])[2:4] + tuple(kept[i])[5:]
    assert {i for i, r in clean.items() if r.text != kept[i].text} == {i for i, r in kept.items() if all_spans(r.text)}
    after = [(r.doc_id, r.text, r.lang, r.source) for r in c.collect()]
    size, per, target = plain.mix(after) if after else ([], {}, {})
    d = stages["mix"](spark, c, sf_dir)
    taken = dict.fromkeys(per, 0)
    for r in d.collect():
        taken[r.source] += len(plain.split(r.text))
    extra = {r.doc_id: tuple(r)[5:] for r in d.collect()}
    assert all(extra[i] == tuple(clean[i])[5:] for i in extra)
    assert d.columns == docs.columns and all(abs(taken[s] - math.floor(target[s])) <= 1 for s in per)
    e = stages["encode"](spark, d, sf_dir)
    assert e.count() == d.count() and e.where("not exact").count() == 0


def test_run(case, spark):
    """The whole run: the stages one after another, and each row's pieces by the encoder alone."""
    _, sf_dir = case
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[:2] == ["doc_id", "source"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    coder, want = op6_pieces.Pieces(queries.tokenizer_path("piece_bpe_32k.model")), []
    for r in docs.collect():
        ways, plain_bytes = coder.encode([r.text or ""])[0]
        want.append((r.doc_id, r.source, len(ways[0][1]) // 4, zlib.crc32(ways[0][1]), coder.undo(plain_bytes) == (r.text or "")))
    assert sorted(((r.doc_id, r.source, r.n_pieces, r.ids_crc32, r.exact) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert op1_pii.KINDS[:4] == ["email", "ip", "card", "phone"]

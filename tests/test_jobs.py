"""The jobs over small tables and copies that grow."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from jobs import common, growing_census, queries, reading_lists
from loomquest.functions import goals as G
from loomquest.operators import items, many, rank
from loomquest.sources import corpora
from loomquest.streaming.census import CensusTable

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, source string"
HITS = "rec_ord long, hit_ord int, relevance double, title string, url string, snippet string, source string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put(spark, folder, name, docs):
    """One more file of documents, as a harvest would add it."""
    made = f"{folder}.{name}"
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(made)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(made) if f.startswith("part-"))
    shutil.copy(f"{made}/{part}", f"{folder}/{name}.parquet")


def counted(spark, docs):
    """The census over all documents at once; a document counts once."""
    f = corpora.as_facts(spark.createDataFrame(list(dict.fromkeys(docs)), DOCS)).selectExpr("fact as item", "cast(doc_id as string) as url", "coalesce(query = 'src1', false) as vetted", "struct(doc_id, pos) as ord")
    return {(r.key, r.item, r.sources, r.vetted, *r["first"]) for r in items.census_list(items.mentions(f)).collect()}


def result(df):
    return {(r.key, r.item, r.sources, r.vetted, r.first_doc, r.first_line) for r in df.collect()}


MONDAY = [(1, "Oboe\nThe Lute (old)", "src0"), (2, "oboe\nviola", "src1"), (3, None, "src0"), (4, "", None)]
TUESDAY = [(2, "oboe\nviola", "src1"), (5, "Viola\nharp\nharp", "src0"), (6, "LUTE", "src1")]


def test_census_takes_only_what_is_new(spark, tmp_path):
    folder, out, config = str(tmp_path / "in"), str(tmp_path / "out"), common.settings("growing_census")
    put(spark, folder, "monday", MONDAY)
    assert result(growing_census.run(spark, folder, out, config)) == counted(spark, MONDAY)
    put(spark, folder, "tuesday", TUESDAY)
    second = growing_census.run(spark, folder, out, config)
    assert result(second) == counted(spark, MONDAY + TUESDAY)
    batches = spark.read.parquet(f"{out}/state/urls").groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in batches} == {0: 2, 1: 3}  # documents without mentions leave no trace
    before = rows(second)
    assert rows(growing_census.run(spark, folder, out, config)) == before
    assert {r.band for r in spark.read.parquet(f"{out}/result").select("band").distinct().collect()} == {"single", "some"}


def test_census_of_many_files_equals_one_count(spark, tmp_path):
    docs = [(i, "\n".join(f"name{(i * k) % 17}" for k in range(5)), f"src{i % 3}") for i in range(60)]
    folder, config = str(tmp_path / "in"), common.settings("growing_census") | {"files_per_batch": 1, "buckets": 4}
    for k in range(4):
        put(spark, folder, f"f{k}", docs[k * 15 : k * 15 + 20])  # five documents of each file come again
    assert result(growing_census.run(spark, folder, str(tmp_path / "out"), config)) == counted(spark, docs)


@pytest.mark.parametrize("after", ["mentions", "urls", "census"])
def test_census_survives_a_crash_in_a_batch(spark, tmp_path, monkeypatch, after):
    """The second batch stops when one of its tables is written; the next run takes it again."""
    folder, out, config = str(tmp_path / "in"), str(tmp_path / "out"), common.settings("growing_census")
    put(spark, folder, "monday", MONDAY)
    growing_census.run(spark, folder, out, config)
    put(spark, folder, "tuesday", TUESDAY)
    write = CensusTable._write

    def stops(self, d, name, *parts):
        write(self, d, name, *parts)
        if name == after:
            raise RuntimeError("lost")

    monkeypatch.setattr(CensusTable, "_write", stops)
    with pytest.raises(Exception, match="lost"):
        growing_census.run(spark, folder, out, config)
    monkeypatch.setattr(CensusTable, "_write", write)
    assert result(growing_census.run(spark, folder, out, config)) == counted(spark, MONDAY + TUESDAY)


def test_census_of_no_documents(spark, tmp_path):
    put(spark, str(tmp_path / "in"), "none", [])
    assert growing_census.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), common.settings("growing_census")).collect() == []


def test_lists_are_those_of_each_goal_alone(spark, tmp_path):
    hits = corpora.as_hits(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).cache()
    wanted = [(1, "list of all oned and thation terms"), (2, "what is on"), (3, None), (4, "zzzzqx"), (5, "list of zzzzqx"), (6, "thered edst heron inble")]
    got = many.rank_for_goals(hits, spark.createDataFrame([(i, g, G.is_enumerable(g)) for i, g in wanted], "goal_id long, goal string, listing boolean"), 5).collect()
    for i, g in wanted:
        alone = rank.rank_sources(hits, g, 5, G.is_enumerable(g)).collect()
        assert sorted(tuple(r)[1:] for r in got if r.goal_id == i) == sorted(map(tuple, alone))


def test_lists_in_blocks_and_small_slices(spark, monkeypatch):
    data = [(i, 0, float(i % 3), f"{'50 words' if i % 5 == 0 else 'about'} {w}", f"u{i % 23}" if i % 11 else "", f"{w} {'dogs' if i % 2 else 'cats'}", "s") for i, w in enumerate(["red", "green", "blue", "cats"] * 40)]
    hits, wanted = spark.createDataFrame(data, HITS).repartition(5), [(i, g, bool(i % 2)) for i, g in enumerate(["red cats", "blue", "dogs and cats", "green dogs", "none of it", "red green blue"])]
    asked = spark.createDataFrame(wanted, "goal_id long, goal string, listing boolean")
    want = [sorted(map(tuple, rank.rank_sources(hits, g, 3, x).collect())) for _, g, x in wanted]
    for most, cells in ((200_000, 2_000_000), (3, 12)):
        monkeypatch.setattr(many, "MOST_TOKENS", most)
        monkeypatch.setattr(many, "CELLS", cells)
        got = many.rank_for_goals(hits, asked, 3).collect()
        assert [sorted(tuple(r)[1:] for r in got if r.goal_id == i) for i, _, _ in wanted] == want
    assert many.rank_for_goals(hits.limit(0), asked, 3).collect() == [] and many.rank_for_goals(hits, asked.limit(0), 3).collect() == []


def test_goals_on_topic_need_no_other_list(spark, monkeypatch):
    """The lists for goals off every topic take two more passes over all texts; they are made only for such goals."""
    made = []
    monkeypatch.setattr(many, "rank_sources", lambda *a: made.append(a[3]) or rank.rank_sources(*a))
    hits = spark.createDataFrame([(i, 0, float(i), "50 words", f"u{i}", "red cats", "s") for i in range(4)], HITS)
    ask = lambda goals: many.rank_for_goals(hits, spark.createDataFrame(goals, "goal_id long, goal string, listing boolean"), 2).collect()
    assert {r.url for r in ask([(1, "red", False), (2, "cats", True)])} == {"u3", "u2"} and made == []
    assert sorted((r.goal_id, r.rank, r.url) for r in ask([(1, "red", False), (2, "zzz", True), (3, "yyy", True)])) == [(g, k, f"u{4 - k}") for g in (1, 2, 3) for k in (1, 2)] and made == [True]


def test_overlaps_count_each_token_once(monkeypatch):
    tokens, texts = [["red", "cats"], ["red"], [], ["cat", "cats", "red"], ["none"]], ["red red cats", "", "scats", "colored", "none red"]
    want = [[sum(t in x for t in own) for own in tokens] for x in texts]
    for cells in (2_000_000, 1):
        monkeypatch.setattr(many, "CELLS", cells)
        assert many._Index(tokens, [False] * 5).overlaps(texts).tolist() == want
    assert many._Index([[]], [False]).overlaps(["a"]).tolist() == [[0]]


def test_lists_rerun_safely(spark, tmp_path):
    out, config = str(tmp_path / "out"), common.settings("reading_lists")
    goals = str(tmp_path / "goals.parquet")
    run = lambda: reading_lists.run(spark, f"{DATA}/documents.parquet", f"{DATA}/labels.parquet", goals, out, config)
    spark.createDataFrame([(i, f"edst thation heron {i}") for i in range(10)], "item_id long, text string").write.parquet(goals)
    first = rows(run())
    assert rows(run()) == first and {r[0] for r in first} == set(range(10))
    spark.createDataFrame([(3, "edst thation heron 3")], "item_id long, text string").write.mode("overwrite").parquet(goals)
    assert rows(run()) == [r for r in first if r[0] == 3]


def test_settings(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"buckets": 3}))
    assert common.settings("reading_lists", str(f)) == {"sources_per_goal": 8, "buckets": 3}
    f.write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError, match="bucket"):
        common.settings("reading_lists", str(f))


@pytest.mark.parametrize("name, inputs", [("reading_lists", ["--labels", f"{DATA}/labels.parquet", "--goals", f"{DATA}/benchmark.parquet"]), ("growing_census", [])])
def test_command_lines(tmp_path, name, inputs):
    command = [sys.executable, "-m", f"jobs.{name}", "--documents", f"{DATA}/document[s].parquet", *inputs, "--out", str(tmp_path / "out")]
    done = subprocess.run(command, cwd=ROOT, env=os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and "read 200 " in done.stderr and "wrote" in done.stderr, done.stderr[-2000:]


def test_queries_leave_settings_alone(spark):
    before = dict(spark.conf.getAll)
    a, b = queries.job2_growing_census(spark, DATA), queries.job2_growing_census(spark, DATA)
    assert rows(a) == rows(b) and set(a.inputFiles()).isdisjoint(b.inputFiles())
    assert dict(spark.conf.getAll) == before

"""The entry points hold together, with and without the corpus operators."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from jobs import queries as jobs
from loomquest import catalogue

DATA = "/root/testdata/sf0.001"


def test_names():
    known = E.queries()
    assert set(E.oracle_sql()) <= set(known) and set(catalogue.QUERIES) <= set(known)


def test_entry(spark):
    assert E.entry(spark).columns == ["rank", "item", "n_sources", "n_corroborated"] and E.entry(spark).count() > 0


def test_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/loomquest", f"{root}/jobs", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "loomquest" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.split(" ", 1) == [str(len(catalogue.QUERIES | jobs.QUERIES)), "[]\n"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return con


def plain(rows):
    cell = lambda x: None if x is None else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


SQL = catalogue.ORACLE_SQL | jobs.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, duck, name):
    df = (catalogue.QUERIES | jobs.QUERIES)[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    result = duck.execute(SQL[name])
    place = [d[0] for d in result.description]
    assert sorted(place) == columns
    assert got == plain([[r[place.index(c)] for c in columns] for r in result.fetchall()])


def test_pages_of_many_links(spark, tmp_path):
    html = "".join(f'<a href="/p{i}">word list {i}</a>' for i in range(450))
    spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert catalogue.QUERIES["page_outlinks"](spark, str(tmp_path)).count() == 450

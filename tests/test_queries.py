"""Every query with SQL against DuckDB, and the rest for rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import file_queries  # noqa: F401  registers its queries
from quire.plans import queries as plans


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, tables, name):
    assert rows(plans.queries()[name](spark, sf_dir).toPandas()) == rows(tables.execute(plans.oracle_sql()[name]).fetchdf())


def test_wrapped_lines_are_narrow(spark, sf_dir):
    stats = plans.wrap_line_stats(spark, sf_dir)
    assert stats.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "line_no", "line"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_are_dealt_to_tasks_by_the_size_of_the_table(spark):
    from quire.plans.queries import _spread

    rows = spark.range(1000).selectExpr("id div 3 AS k").coalesce(1)
    dealt = _spread(rows, "k", 100)
    assert dealt.rdd.getNumPartitions() == 10
    parts = dealt.rdd.mapPartitionsWithIndex(lambda i, x: [(r.doc_id, i) for r in x]).collect()
    # all rows are there, those of one document together
    assert len(parts) == 1000 and len(set(parts)) == 334
    assert _spread(rows, "k", 1000).rdd.getNumPartitions() == 1


def test_lines_between_html_tables_stay_together():
    from quire.operators.html import parts_of

    table = ["<table><tr><td>x</td></tr><tr><td>y</td></tr></table>"]
    found = parts_of(["a", "b", *table, "```", "<table>", "```", "c"])
    assert [(t, x) for t, x in found if not t] == [(False, ["a", "b"]), (False, ["```", "<table>", "```", "c"])]


def test_passes_deal_documents_to_the_tasks_asked_for(spark):
    from quire.operators import blocks, footnotes

    docs = spark.createDataFrame([(i, ["7. a", "see.[^9]"]) for i in range(40)], "doc_id long, lines array<string>").coalesce(1)
    for change in (blocks.renumber_lists, footnotes.convert_footnotes):
        done = change(docs, tasks=7)
        assert done.rdd.getNumPartitions() == 7
        assert {r.doc_id: r.lines for r in done.collect()} == {r.doc_id: r.lines for r in change(docs).collect()}

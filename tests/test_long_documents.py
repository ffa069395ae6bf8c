"""Documents read in chunks give what one task gives."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import blocks, lines, long_documents

LINES = ["```", "````", "~~~", "~~~~ x", "```rust", "> ```", "> ````", "> a", "> > ~~~", "> > b", "text", "", "1. a", "3. b", "  1. c", "    7. d", "# H", "---", "  word", "- x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LINES[:11]), max_size=40), st.integers(1, 12))
def test_transitions_of_chunks_put_together(doc, size):
    """From every state before a chunk, the summary gives the state that reading it line by line gives."""
    for state in (None, ("`", 3, 0), ("`", 4, 0), ("~", 3, 1), ("`", 3, 1), ("~", 3, 2), ("`", 9, 2)):
        for at in range(0, len(doc), size):
            chunk = doc[at : at + size]
            known = long_documents.json.loads(long_documents.Transition(chunk).summary())
            reader = lines.FenceState()
            reader.open = state
            for x in chunk:
                reader.read(x)
            assert long_documents.applied(known, state) == (reader.open, reader.block)


def documents(seed, n):
    rng = random.Random(seed)
    return {i: [rng.choice(LINES if i % 2 else LINES[11:]) for _ in range(rng.randrange(n))] for i in range(12)} | {99: []}


def rows_of(spark, docs):
    return spark.createDataFrame([(d, i, x) for d, ls in docs.items() for i, x in enumerate(ls)], "doc_id long, line_no long, line string")


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_chunks_give_what_arrays_give(spark, size):
    docs = documents(size, 60)
    arrays = spark.createDataFrame(list(docs.items()), "doc_id long, lines array<string>")
    states = {(r.doc_id, r.line_no): (r.was_in, r.marker, r.is_in, r.block) for r in long_documents.fence_states(rows_of(spark, docs), size).collect()}
    want = arrays.select("doc_id", F.posexplode(lines.fence_state(F.col("lines"))).alias("i", "f")).select("doc_id", "i", "f.*").collect()
    assert states == {(r.doc_id, r.i): (r.was_in, r.marker, r.is_in, r.block) for r in want}
    found = {(r.doc_id, r.line_no): r.line for r in long_documents.renumber(rows_of(spark, docs), size).collect()}
    want = {r.doc_id: r.lines for r in blocks.renumber_lists(arrays).collect()}
    assert found == {(d, i): x for d, ls in want.items() for i, x in enumerate(ls or [])}


def test_no_lines(spark):
    assert long_documents.renumber(rows_of(spark, {1: []})).count() == 0
    odd = spark.createDataFrame([("a", 0, None), ("a", 1, "2. x")], "doc_id string, line_no int, line string")
    assert [tuple(r) for r in long_documents.renumber(odd, 1).orderBy("line_no").collect()] == [("a", 0, None), ("a", 1, "1. x")]


def test_a_document_over_many_tasks(spark):
    """300,000 lines of one document: no task reads more than a few chunks of it."""
    n, size = 300_000, 8192
    line = F.when(F.col("id") % 1000 == 7, "```").when(F.col("id") % 5 == 0, "9. item").otherwise("   more")
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("line_no"), line.alias("line"))
    found = long_documents.renumber(rows, size)
    shown = found.where("line_no % 5 = 0").orderBy("line_no").collect()
    number = 0
    for r in shown:
        inside = r.line_no % 2000 >= 7 and r.line_no % 2000 < 1007 or r.line_no % 1000 == 7
        number += not inside
        assert r.line == ("9. item" if inside else f"{number}. item")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = long_documents.fence_states(rows, size).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < n

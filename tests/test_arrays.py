"""Passes over documents as arrays: states carried along, and nothing shuffled or computed twice."""

import pytest
from pyspark.sql import functions as F

from quire.functions.arrays import let, part, scan
from quire.operators import footnotes
from quire.plans import queries as plans
from quire.plans.pipeline import Options, normalize


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_states_are_carried_over_chunks(spark, n):
    made = spark.range(1).select(F.expr(f"sequence(1, {n})").alias("x")) if n else spark.sql("SELECT cast(array() AS array<int>) AS x")
    got = made.select(scan(F.col("x"), F.lit(0), lambda s, x: s + x.cast("int")).alias("s"), let(F.size("x"), lambda n: n + n).alias("twice"), part(F.col("x"), F.lit(1), F.lit(3)).alias("p")).first()
    assert got.s == [i * (i + 1) // 2 for i in range(1, n + 1)] and got.twice == 2 * n and got.p == list(range(2, min(n, 3) + 1))


def test_footnotes_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, ["a[^7] b[^3]", "", "[^3]: x", "", "[^7]: y", "  z"]), (2, None)], "doc_id long, lines array<string>")
    done = footnotes.convert_footnotes(docs)
    assert "Exchange" not in plan_of(done) and "ArrowEvalPython" not in plan_of(done)
    assert {r.doc_id: r.lines for r in done.collect()} == {1: ["a[^1] b[^2]", "", "[^1]: y", "  z", "", "[^2]: x"], 2: []}


def test_the_whole_normaliser_shuffles_nothing(spark):
    every = Options(wrap=True, ellipsis=True, fences=True, footnotes=True, code_emphasis=True, headings=True, renumber=True, breaks=True)
    lines = ["Title", "===", "", "~~~", "x...", "~~~", "", "3. a", "9. b", "", "|a|b|", "|c|d...|", "", "so.7 `x`**y**", "and on...", "", "---", "", "[^7]: note"]
    docs = spark.createDataFrame([(i, lines) for i in range(40)], "doc_id long, lines array<string>").repartition(3)
    done = normalize(docs, every)
    assert plan_of(done).count("Exchange") == 1 and done.rdd.getNumPartitions() == 3
    want = ["# Title", "", "```", "x...", "```", "", "1. a", "2. b", "", "| a | b  |", "| c | d… |", "", "so.[^1] **`x`y** and on…", "", "_" * 70, "", "[^1]: note"]
    assert {r.doc_id: r.lines for r in done.collect()} == dict.fromkeys(range(40), want)


def test_full_pipeline_writes_no_lines_to_disk(spark, sf_dir):
    """A table of one task isn't dealt, so that nothing is shuffled at all."""
    done = plans.full_pipeline(spark, sf_dir)
    assert "Exchange" not in plan_of(done) and done.columns == ["doc_id", "line_no", "line"]

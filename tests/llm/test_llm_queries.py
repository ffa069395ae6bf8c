"""Queries with SQL against DuckDB, the classifier's tables against plain loops, and long texts."""

import glob
import math
import os
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, neardup, packing, pii, quality, queries, secret_scan


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, tables, name):
    got, want = queries.queries()[name](spark, sf_dir), tables.execute(queries.oracle_sql()[name]).fetchall()
    names = [d[0] for d in tables.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want))


# 9


def some_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(quality.FEATURES)))
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    return x, y


def plain_score(model, row):
    """One row, bin by bin."""
    place = lambda edges, v: sum(e <= v for e in edges)
    total = model.intercept + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, row))
    total += sum(t[place(model.pair_edges[a], row[a])][place(model.pair_edges[b], row[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
    return 1 / (1 + math.exp(-total))


def test_scores_against_plain_additions():
    x, y = some_rows(1)
    model = quality.fit(x, y)
    got = model.score(x)
    assert np.allclose(got, [plain_score(model, r) for r in x.tolist()], atol=1e-12)
    assert ((got > 0.5) == y).mean() > 0.9 and (1, 2) in model.pairs


def plain_tree(g, w, leaves):
    """The tree by trying every cut of every leaf, sums taken anew each time."""
    cuts = [0, len(g)]
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(w[a:b]) + quality.RIDGE)
    while len(cuts) <= leaves:
        gains = [(value(a, k) + value(k, b) - value(a, b), k) for a, b in zip(cuts, cuts[1:]) for k in range(a + 1, b)]
        if not gains or max(gains)[0] <= 1e-9:
            break
        cuts = sorted([*cuts, max(gains)[1]])
    return [sum(g[a:b]) / (sum(w[a:b]) + quality.RIDGE) for a, b in zip(cuts, cuts[1:]) for _ in range(a, b)]


@pytest.mark.parametrize("seed", range(20))
def test_trees_against_trying_every_cut(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 15))
    g, w = rng.normal(size=n), rng.random(n)
    assert np.allclose(quality._tree(g, w, 3), plain_tree(g.tolist(), w.tolist(), 3))


def test_boosting_against_plain_loops(monkeypatch):
    """The tables of features after a few rounds, row by row."""
    monkeypatch.setattr(quality, "ROUNDS", 3)
    x, y = some_rows(2, 120)
    model = quality.fit(x, y)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    bins = [[sum(e <= v for e in edges[j]) for v in x[:, j].tolist()] for j in range(x.shape[1])]
    total = [math.log((y.sum() + 1) / (len(y) + 1 - y.sum()))] * len(y)
    want = [[0.0] * (len(e) + 1) for e in edges]
    for _ in range(3):
        for j in range(x.shape[1]):
            g, w = [0.0] * len(want[j]), [0.0] * len(want[j])
            for i, b in enumerate(bins[j]):
                p = 1 / (1 + math.exp(-total[i]))
                g[b] += y[i] - p
                w[b] += p * (1 - p)
            steps = [quality.RATE * v for v in plain_tree(g, w, quality.LEAVES)]
            want[j] = [a + b for a, b in zip(want[j], steps)]
            total = [t + steps[b] for t, b in zip(total, bins[j])]
    assert all(np.allclose(a, b) for a, b in zip(model.tables, want))


def test_training_on_clashing_names(spark):
    docs = spark.createDataFrame([(i, "Good words. " * (i % 7 + 1) if i % 2 else "!!! || " * (i % 5 + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    plain = quality.train(docs, labels, F.lit(True))
    more = {x: F.lit("z") for x in ("x", "quality", "score", "found")}
    odd = quality.train(docs.withColumns(more), labels.withColumns({x: F.lit("z") for x in ("text", "x", "score")}), F.lit(True))
    assert all((a == b).all() for a, b in zip(plain.tables, odd.tables))
    scores = {r.doc_id: r.score for r in quality.scored(docs.withColumns(more), odd).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(200))


# long texts and columns of other types


@pytest.mark.parametrize("unit", ["word ", "a@b.cd ", "1.2.3.4 ", "4111 1111 1111 1111 ", "+1 415 555 0100 ", "john at example dot com ", "five ", "password=abcdefg ", "deadbeef" * 4 + " ", "x"])
def test_scans_of_long_texts_are_linear(unit):
    text = unit * (600_000 // len(unit))
    began = time.time()
    pii.scan(text)
    secret_scan.redacted(text)
    assert time.time() - began < 20


def test_long_texts_through_operators(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "a b c"), (4, "ab " * 100_000)], "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles > 0, r.component_id) for r in neardup.near_duplicates(docs, 85).collect()}
    assert found == {1: (True, 1), 2: (True, 1), 3: (True, 3), 4: (True, 4)}
    pieces = packing.pack(docs, queries.word_bpe_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == 4 and all(r.n == r.m for r in pieces)


def test_contamination_of_texts_of_another_type(spark):
    docs = spark.createDataFrame([(1, 12), (2, 34)], "doc_id long, text int")
    items = spark.createDataFrame([(7, "12"), (8, "99")], "item_id long, text string")
    assert [(r.doc_id, len(r.spans) > 0) for r in decontaminate.contamination(docs, items).orderBy("doc_id").collect()] == [(1, True), (2, False)]

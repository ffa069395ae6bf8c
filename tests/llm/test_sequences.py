"""BPE, prefix tries and runs against a library and plain programs, and on odd rows."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import bpe, prefix_trie, queries, runs
from quire.llm.store import table

PATH = queries.byte_bpe_path()


# 11


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'s", "'LL", "é", "漢字", "🙂", "1", "²", "Ⅳ", "<|endoftext|>", "<|end", "\x00", "\x85", "　", "́", "x" * 70, "ab" * 40]), max_size=25).map("".join))
def test_bpe_as_the_library(library, text):
    known = bpe.vocabulary(PATH)
    ids = known.encode(text)
    assert ids == encoded(library, text)
    assert known.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_bpe_of_any_characters(library):
    rng, known = random.Random(3), bpe.vocabulary(PATH)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(12))
        assert known.encode(text) == encoded(library, text)
        assert known.decode(known.encode(text)) == text


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6))
def test_merges_of_rows_and_of_one_word(words):
    """Both forms of the tree, and a program that looks at all pairs each time."""
    pairs = [(0, 1, 4), (1, 0, 5), (0, 0, 6), (4, 4, 7), (2, 3, 8), (6, 6, 9), (8, 0, 10), (7, 6, 11)]
    ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs)}

    def plain(x):
        x = [*x]
        while some := [(ranks[p][0], i) for i, p in enumerate(zip(x, x[1:])) if p in ranks]:
            r, i = min(some)
            x[i : i + 2] = [pairs[r][2]]
        return x

    want = list(map(plain, words))
    assert [bpe.merged(w, ranks) for w in words] == want
    wide = max(2, *map(len, words))
    rows = bpe.merged_rows(np.array([w + [-1] * (wide - len(w)) for w in words]), bpe.Merges(pairs))
    assert [[x for x in row.tolist() if x >= 0] for row in rows] == want


def test_bpe_of_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    known = bpe.Vocabulary(PATH)
    texts = ["one two three four", "five six one", "", "two nine <|endoftext|> one"]
    for _ in range(3):
        assert known.encode_all(texts) == [encoded(library, x) for x in texts]


def test_bpe_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op11_bpe(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = encoded(library, r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_on_odd_rows(spark, library):
    texts = [None, "", " \n", "a", "a", "b" * 300_000, "word " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({x: F.lit("z") for x in ("found", "ids", "Decoded", "n_tokens_")})
    found = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert "n_tokens_" in found.columns and found.where("n_tokens_ = 'z' and found = 'z'").count() == 7
    for r in found.collect():
        assert bytes(r.ids) == encoded(library, texts[r.doc_id] or "") and r.decoded == (texts[r.doc_id] or "")
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), (bytes([255, 0, 0, 0]),), (b"\xff\xff\xff\xff",)], "ids binary"), PATH).select("decoded").collect()[0][0] == ""


# 12


def brute_trie(rows):
    """The contract of the trie, over dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(built[c][:d], []).append(c)
    children, out = {}, []
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    total = {}
    for k in sorted(nodes, key=len, reverse=True):
        below = [total[x] for x in children.get(k, [])]
        saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        total[k] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in nodes[k] if len(built[c]) == len(k))
        parent = nodes[k[:-1]][0] if k else None
        out.append((nodes[k][0], len(k), parent, len(nodes[k]), len(children.get(k, [])), *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumns({x: F.lit("z") for x in ("base", "pos", "piece", "a", "depth", "ka")})
    return sorted((tuple(r[c] for c in NAMES) for r in prefix_trie.prefix_trie(turns).collect()), key=lambda r: r[:2])


def some_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "é", "", None, "long " * 9])) for c in convs for t in range(rng.randrange(most)) if rng.random() < 0.9]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_plain_program(spark, seed):
    rows = some_rows(seed, [*range(40), -7, -3, 1003, 2**40 + 1], 12)
    rows += [(5, None, "user", "hi"), (5, None, None, None), (None, 1, "user", "hi"), (6, 2, "user", "hi"), (6, 2, "user", "hi")]
    # equal turns of one role differ in nothing else here, so their order says nothing
    rows = list({(c, t): r for r in rows for c, t in [r[:2]]}.values()) + [(9, 3, "user", "twice")] * 2
    rows = [r for r in rows if r[:2] != (9, 3) or r[3] == "twice"]
    assert trie(spark, rows) == brute_trie(rows)


@pytest.mark.parametrize("piece", [8, 16])
def test_trie_of_long_conversations_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "TEXT", 20)
    rng = random.Random(piece)
    rows = []
    for c in (*range(20), 77):
        shared = rng.choice([0, 30, 61])
        rows += [(c, t, "user", f"t{t}" if t < shared else f"{c} {t}") for t in range(rng.choice([3, 20, 61, 90]))]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_copies_and_nothing(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)]
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []
    assert trie(spark, [(3, 0, "user", "x")]) == brute_trie([(3, 0, "user", "x")])


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in NAMES) for r in queries.op12_prefix_trie(spark, sf_dir).collect()]
    assert sorted(got, key=lambda r: r[:2]) == brute_trie(rows)


# 13


def brute_runs(t):
    n, out = len(t), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(q % p == 0 and all(t[x] == t[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_squares(t, most):
    return {(q, tuple(t[s : s + 2 * q])) for q in range(1, most + 1) for s in range(len(t) - 2 * q + 1) if t[s : s + q] == t[s + q : s + 2 * q]}


SEQUENCES = st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k - 1), min_size=2, max_size=45))


@settings(max_examples=600, deadline=None)
@given(SEQUENCES, st.integers(0, 45), st.integers(1, 7))
@example([0, 1, 0] * 12, 45, 1)
def test_runs_and_squares_against_looking_everywhere(t, a, p):
    t = [t[i] if i < a else t[a + (i - a) % p] for i in range(len(t))]
    tree = runs.SuffixTree(t)
    assert sorted(tree.leaves) == list(range(len(t) + 1))
    for most in (len(t) // 2, max(1, len(t) // 4)):
        found = runs.vocabulary(tree, most)
        assert {(q, tuple(t[tree.least[v] : tree.least[v] + 2 * q])) for q in found for v in found[q]} == brute_squares(t, most)
    assert runs.stretch_runs(t) == brute_runs(t)
    words = " ".join(f"w{x}" for x in t)
    assert [tuple(r.values()) for r in runs.described(np.frombuffer(words.encode(), np.uint8))["runs"]] == brute_runs(t)


@pytest.mark.parametrize("item", [lambda i: 1, lambda i: i % 2, lambda i: i % 4999, lambda i: bin(i).count("1") % 2, lambda i: zlib.crc32(str(i).encode()) % 2])
def test_runs_take_linear_time(item):
    """Tenfold words in at most some fortyfold time."""
    took = []
    for n in (10_000, 100_000):
        began = time.time()
        runs.stretch_runs([item(i) for i in range(n)])
        took.append(time.time() - began)
    assert took[1] < 40 * max(took[0], 0.05)


def brute_op13(doc_id, text):
    import re

    w = re.findall(r"[^ \t-\r]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def op13(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = queries.op13_runs(spark, str(tmp_path))
    assert dict(found.dtypes)["exponent_milli"] == dict(found.dtypes)["n_runs"] == "bigint"
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=lambda r: (r[0] is None, r[0]))


def test_runs_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a a a a a a", "a b a b a b a b", "a a a a a", "x\x0by x\x0cy x y x y", "é 漢 é 漢 é 漢 é 漢 é", "a " * 3000, "a b c " * 500 + "d e " * 400]
    rows = [(i, x) for i, x in enumerate(texts)]
    rows += [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(100, 400)]
    # repeated ids and texts
    rows += [(7, "b b b b b b c"), (7, "b b b b b b c")]
    want = sorted((brute_op13(*r) for r in rows), key=lambda r: (r[0], r))
    assert sorted(op13(spark, tmp_path, rows), key=lambda r: (r[0], r)) == want
    assert op13(spark, tmp_path, [(None, "c c c c c c d")])[0][1:6] == (1, 0, 6, 1, 6000)


def test_runs_query(spark, sf_dir):
    short = [r for r in table(spark, sf_dir, "documents").collect() if len((r.text or "").split()) < 400]
    got = {r.doc_id: r for r in queries.op13_runs(spark, sf_dir).collect()}
    for r in short:
        x = got[r.doc_id]
        assert (x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == brute_op13(r.doc_id, r.text)


def test_runs_of_docs_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 7, 5)], "doc_id long, text string, runs int").withColumns({x: F.lit("z") for x in ("found", "N_words", "best")})
    found = runs.periodic_runs(docs)
    assert [r.asDict(True) for r in found.select("n_words", "runs", "collapsed", "best").collect()] == [{"n_words": 7, "runs": [{"start": 0, "length": 7, "period": 1}], "collapsed": "a", "best": "z"}]
    assert runs.periodic_runs(docs.limit(0)).count() == 0

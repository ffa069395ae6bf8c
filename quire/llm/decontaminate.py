"""Benchmark decontamination by winnowing.

Fingerprints of a word sequence are the least K-gram hashes of each W consecutive K-grams. Any
K + W - 1 = 10 consecutive words that a document shares with an item share such a minimum, so the
join on fingerprints misses no shared window. Every hit is then extended: the 10-word windows that
contain the matching K-gram are compared with the items' windows by two hashes from independent word
hashes, and the words of those that agree are hit. Items of fewer than 10 words lie below the guarantee; they have one window
each, looked up by its full hash for each such length.

The benchmark is read in blocks of at most BLOCK_WORDS words. Each block is one pass over the
documents in which only that block is sent to the tasks, so what is broadcast has a fixed bound. With
several blocks the hits of each are written before the next is read, and merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import materialize, scratch

WINDOW, K = 10, 5
WINNOW = WINDOW - K + 1
BLOCK_WORDS = 4_000_000
BLOCK_ITEMS = 200_000


def _fingerprints(h: np.ndarray) -> np.ndarray:
    """For each position of a K-gram: whether it is the minimum of some winnowing window."""
    grams = W.windows(h, K)
    least = W.sliding_min(grams, WINNOW)
    if not len(least):
        return np.zeros(len(grams), bool), grams
    # a K-gram at p is a minimum when it equals one of the least values of windows p-WINNOW+1 .. p
    near = np.zeros(len(grams), bool)
    for shift in range(WINNOW):
        near[shift : shift + len(least)] |= grams[shift : shift + len(least)] == least
    return near, grams


class Block:
    """Window hashes of some items, sorted, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]]):
        prints, by_length = [np.empty(0, np.uint64)], {}
        for item, raw in items:
            _, _, h, g = W.words(raw, W.ALNUM, True, (0, 1))
            size = min(WINDOW, len(h))
            if not size:
                continue
            # each pair of hashes once
            pairs = np.unique(np.stack((W.windows(h, size), W.windows(g, size, W.BASE_B))), axis=1)
            by_length.setdefault(size, []).append((*pairs, np.full(pairs.shape[1], item, object)))
            if size == WINDOW:
                at, grams = _fingerprints(h)
                prints.append(grams[at])
        self.prints = np.unique(np.concatenate(prints))
        self.tables = {}
        for size, parts in by_length.items():
            a, b, items_of = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((b, a))
            self.tables[size] = a[order], b[order], items_of[order]

    def _lookup(self, size: int, h: np.ndarray, g: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, set]:
        """Which of the windows of that size at starts occur, and the items that hold them."""
        a, b, items = self.tables[size]
        x = W.windows(h, size)[starts]
        left = np.searchsorted(a, x)
        some = left < len(a)
        some[some] = a[left[some]] == x[some]
        starts, left, x = starts[some], left[some], x[some]
        if not len(starts):
            return starts, set()
        y = W.windows(g, size, W.BASE_B)[starts]
        right = np.searchsorted(a, x, "right")
        found, good = set(), np.zeros(len(starts), bool)
        seen: dict[tuple[int, int], bool] = {}
        for i, (lo, hi, u, v) in enumerate(zip(left.tolist(), right.tolist(), x.tolist(), y.tolist())):
            if (u, v) not in seen:
                same = items[lo:hi][b[lo:hi] == v]
                seen[u, v] = bool(len(same))
                found.update(same.tolist())
            good[i] = seen[u, v]
        return starts[good], found

    def hits(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, set]:
        """Which words of a document (their two hashes) are hit, and the items whose windows occur."""
        hit, found = np.zeros(len(h) + 1, np.int64), set()
        for size in self.tables:
            n = len(h) - size + 1
            if n <= 0:
                continue
            if size == WINDOW:
                at, grams = _fingerprints(h)
                at = np.flatnonzero(at)
                place = np.searchsorted(self.prints, grams[at])
                place[place == len(self.prints)] = 0
                at = at[self.prints[place] == grams[at]]
                if not len(at):
                    continue
                near = np.zeros(n, bool)
                for shift in range(WINNOW):
                    x = at - shift
                    near[x[(x >= 0) & (x < n)]] = True
                starts = np.flatnonzero(near)
            else:
                starts = np.arange(n)
            starts, items = self._lookup(size, h, g, starts)
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + size, -1)
            found |= items
        return np.cumsum(hit[:-1]) > 0, found


def digest(items) -> str:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _scan(block):
    @F.arrow_udf(_SCHEMA)
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = block.value
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        for column in columns:
            out = []
            for raw in W.slices(column):
                _, _, h, g = W.words(raw if raw is not None else np.empty(0, np.uint8), W.ALNUM, True, (0, 1))
                hit, items = known.hits(h, g)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                ids = sorted(str(x) for x in items if x is not None)
                out.append((len(h), edge.tolist(), ids + [None] * (None in items)))
            yield pa.array([dict(zip(("n_words", "spans", "items"), x)) for x in out], kind)

    return scan


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Block, bool]]:
    """The benchmark in blocks of bounded size, read by the driver one block at a time, and whether
    more of them follow."""
    rows, size = [], 0
    chosen = benchmark.where("text is not null").select(F.col("item_id").cast("string"), "text")
    for item, text in chosen.toLocalIterator():
        raw = np.frombuffer(text.encode(), np.uint8)
        if rows and (size + len(raw) > 6 * BLOCK_WORDS or len(rows) >= BLOCK_ITEMS):
            yield Block(rows), True
            rows, size = [], 0
        rows.append((item, raw))
        size += len(raw)
    yield Block(rows), False


def merged(spans: list[list[int]]) -> list[int]:
    """Starts and ends in turn of the union of lists of spans."""
    out: list[int] = []
    for a, b in sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)):
        if out and a <= out[-1]:
            out[-1] = max(b, out[-1])
        else:
            out += [a, b]
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def _joined(column: pa.Array) -> pa.Array:
    return pa.array([merged(x) for x in column.to_pylist()], pa.list_(pa.int64()))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, spans (starts and ends in turn of the hit words, in words) and items (the
    ids, as strings, of items with a window in the document; sorted). The benchmark is read when this
    is called; of several blocks, all are met then.

    Null and empty texts have no words and no hits; a null or empty item, or one without words, has
    no window. Items without an id are hit like others; all of them that are in a document stand as
    one null at the end of its items. Repeated items count once, repeated documents are scored each. Columns of docs with
    the names of the new ones are replaced; others stay. Empty tables give no rows or no hits."""
    spark, kept, hits = docs.sparkSession, docs.drop("n_words", "spans", "items"), []
    out, name, row = kept.columns, scratch(kept, "found"), scratch(kept, "row")
    for block, more in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)
        found = kept.withColumn(name, _scan(sent)(F.col("text").cast("string")))
        parts = [F.col(name)[c].alias(c) for c in ("n_words", "spans", "items")]
        if not hits and not more:
            return found.select(*out, *parts)
        # written before the next block is read, so that one block at a time is held
        if not hits:
            kept = materialize(found.withColumn(row, F.monotonically_increasing_id()), "scanned")
            hits.append(kept.where(F.size(F.col(name)["spans"]) > 0).select(F.col(row).alias("row"), *parts[1:]))
            kept = kept.select(*out, row, parts[0])
        else:
            hits.append(materialize(found.where(F.size(F.col(name)["spans"]) > 0).select(F.col(row).alias("row"), *parts[1:]), "hits"))
        sent.destroy()
    every = reduce(DataFrame.union, hits).groupBy("row").agg(
        F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    every = materialize(every.select("row", _joined("spans").alias("spans"), "items"), "merged")
    none = [F.coalesce(every[c], F.array().cast(every.schema[c].dataType)).alias(c) for c in ("spans", "items")]
    return kept.join(every, kept[row] == every["row"], "left").select(*(kept[c] for c in (*out, "n_words")), *none)


def hit_words(spans: F.Column) -> F.Column:
    """How many words the spans cover."""
    sizes = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)

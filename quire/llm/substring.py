"""Exact substring deduplication with a count-min prefilter.

A window is 50 consecutive words. Its key is the least hash of its 11-word grams, so windows of the
same words have the same key, and consecutive windows of a text mostly share theirs: a run is a
maximal stretch of windows with one key, about twenty of them.

1. One pass over the texts writes their runs: key, place, and a hash of the run's windows.
2. Every task sketches the keys of its runs (each once per document) in DEPTH rows of counters that
   stop at 2. The partition sketches are merged block by block. A key's estimate is the least of its
   counters and never below the number of documents that hold any window with that key, so a window
   estimated at 1 is repeated nowhere. Only the bits "2 or more" go to every task. Where the keys are
   too many for the greatest sketch (max_cells), they are met in slices of the key space, each with a
   sketch of its own, so that what is broadcast stays bounded and the filter keeps its strength. The runs are
   written once more for that, a folder for each slice, so that all slices together read them once.
3. Only runs whose key is estimated repeated are grouped, exactly by key and run hash: the least
   document of a run owns it, and to others all of its windows are repeats. Where a key has several
   different runs, the owners' windows are met one by one as well. These runs are marked in a bit
   table of the same bounded kind, and another pass over the texts writes the windows of marked ones;
   a run marked by chance only adds windows that are there. Where they are too many for it, texts and their
   marked runs are joined.

Words covered by repeated windows are marked as spans per document and removed. A window stands for
its words by two hashes from independent word hashes: the key and the window's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import discard, materialize, scratch

WINDOW, GRAM = 50, 11
DEPTH, CELL_BLOCK, MIN_CELLS, MAX_CELLS = 2, 1 << 20, 1 << 20, 1 << 28
#: Counters for each key at least, so that one in twenty unique keys passes by chance.
CELLS_PER_KEY = 4
#: Keys that a task holds before it sends a sketch of them; texts that a Python worker has at a time.
SKETCH_KEYS, TEXT_ROWS = 500_000, 1000
_SEEDS = [np.uint64(0x632BE59BD9B4E019), np.uint64(0xE220A8397B1DCDAF)]


def runs(raw: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of a text, its key, and the hashes of all windows."""
    none = np.empty(0, np.int64)
    if raw is None:
        return none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    _, _, h, g = W.words(raw, which=(0, 1))
    keys = W.sliding_min(W.windows(h, GRAM), WINDOW - GRAM + 1)
    if not len(keys):
        return none, none, keys, keys
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], edge))
    return starts, np.concatenate((edge, [len(keys)])) - 1, keys[starts], W.windows(g, WINDOW, W.BASE_B)


def _cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    return [W.mix(keys ^ seed) % np.uint64(width) for seed in _SEEDS]


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key's bits are set in every row."""
    keep = np.ones(len(keys), bool)
    for row, cells in zip(bits, _cells(keys, bits.shape[1] * 8)):
        keep &= (row[(cells >> np.uint64(3)).astype(np.int64)] >> (7 - (cells & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return keep


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _names(columns: list[pa.Array]) -> np.ndarray:
    """One hash for each row of some columns of integers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = W.mix(out + W.mix(_unsigned(c)))
    return out


_PARTIAL = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("many", pa.binary())])
_MERGED = pa.schema([("block", pa.int32()), ("bits", pa.binary())])


def _sketch(width: int, named: bool):
    """One task's sketch, as blocks of touched cells: row * blocks + block, cells, and which of them
    counted 2 or more. Keys are the first column, or named the hashes of whole rows."""
    blocks = width // CELL_BLOCK

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        out = []
        for row, cells in enumerate(_cells(np.concatenate(parts), width)):
            cells, counts = np.unique(cells.astype(np.uint32), return_counts=True)
            many = counts > 1
            where = np.searchsorted(cells, np.arange(blocks + 1) * CELL_BLOCK)
            for b in np.flatnonzero(np.diff(where)).tolist():
                lo, hi = where[b], where[b + 1]
                out.append((row * blocks + b, (cells[lo:hi] % CELL_BLOCK).astype(np.uint32).tobytes(), np.packbits(many[lo:hi]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _PARTIAL)], schema=_PARTIAL)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            # a row's keys, once for each of its owners
            names, once = np.unique(_names(batch.columns), return_index=True)
            parts.append(names if named else _unsigned(batch.column(0))[once])
            size += len(once)
            if size > SKETCH_KEYS:
                yield emit(parts)
                parts, size = [], 0
        if size:
            yield emit(parts)

    return task


def _merge(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the partial sketches of whole blocks, each counter stopping at 2."""
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, many in zip(*(c.to_pylist() for c in batch.columns)):
                cells = np.frombuffer(cells, np.uint32)
                more = np.unpackbits(np.frombuffer(many, np.uint8), count=len(cells))
                known = counters.setdefault(block, np.zeros(CELL_BLOCK, np.uint8))
                known[cells] = np.minimum(2, known[cells] + 1 + more)
        for block, known in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(known >= least).tobytes()], pa.binary())], schema=_MERGED)

    return merge


def sketch(keys: DataFrame, width: int, least: int, named: bool = False) -> np.ndarray:
    """Bits of DEPTH rows of width counters: which of them count the first column of keys, once for
    each distinct row, at least that often (1 or 2); or named, the hashes of the rows. Hashes of keys are
    taken here, as each Python function of a stage has a worker of its own for each core."""
    blocks = DEPTH * (width // CELL_BLOCK)
    partial = keys.mapInArrow(_sketch(width, named), "block int, cells binary, many binary")
    merged = partial.repartition(min(blocks, 4096), "block").mapInArrow(_merge(least), "block int, bits binary")
    out = np.zeros((blocks, CELL_BLOCK // 8), np.uint8)
    for block, bits in merged.toLocalIterator():  # DEPTH * max_cells bits at most
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(DEPTH, -1)


def sliced(df: DataFrame, by: str, max_cells: int) -> Iterator[tuple[DataFrame, int]]:
    """A written table in as many slices by a column's hash as sketches of max_cells counters need, and the
    counters per row for each. Several slices are written once more, so that each is read alone."""
    n = df.count() * CELLS_PER_KEY
    slices = max(1, -(-n // max_cells))
    width = min(max_cells, max(MIN_CELLS, 1 << (n // slices).bit_length()))
    if slices == 1:
        yield df, width
        return
    numbered = df.withColumn("slice", F.pmod(F.xxhash64(by), F.lit(slices)))
    # a key may be in many rows, so a slice is dealt to several tasks
    dealt = materialize(numbered.repartition("slice", F.pmod(F.xxhash64(*df.columns), F.lit(8))), "slices", "slice")
    for (k,) in sorted(dealt.select("slice").distinct().collect()):
        yield df.sparkSession.read.schema(df.schema).parquet(f"{dealt._written}/slice={k}"), width
    discard(dealt)


_RUNS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("key", pa.int64()), ("run", pa.int64())])
_RUNS_SPARK = "doc_id long, copy int, first long, last long, key long, run long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple]]:
    """Documents and their runs."""
    for batch in batches:
        for doc, copy, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), W.slices(batch.column(2))):
            found = runs(raw)
            if len(found[0]):
                yield doc, copy, found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns, size = [[] for _ in _RUNS], 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(columns, _RUNS)], schema=_RUNS)

    for doc, copy, (first, last, keys, each) in _texts(batches):
        n = len(first)
        run = W.signed(W.stretches(each, first))
        for c, x in zip(columns, (np.full(n, doc), np.full(n, copy, np.int32), first, last, W.signed(keys), run)):
            c.append(x)
        size += n
        if size > 100_000:
            yield rows()
            columns, size = [[] for _ in _RUNS], 0
    if size:
        yield rows()


def _passing(bits):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_holds(bits.value, _unsigned(batch.column("key")))))

    return task


_WINDOWS = pa.schema([*(_RUNS.field(n) for n in (0, 1, 2, 4)), ("windows", pa.list_(pa.int64()))])
_WINDOWS_SPARK = "doc_id long, copy int, first long, key long, windows array<long>"


def _windows(marked: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The windows of chosen runs: (doc, copy, runs of the text, their numbers)."""
    columns, size = [[] for _ in _WINDOWS], 0

    def rows() -> pa.RecordBatch:
        flat = [pa.array(np.concatenate(c), t.type) for c, t in zip(columns, list(_WINDOWS)[:4])]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in columns[4]]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([*flat, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[4])))], schema=_WINDOWS)

    for doc, copy, (first, last, keys, each), at in marked:
        if not len(at):
            continue
        for c, x in zip(columns, (np.full(len(at), doc), np.full(len(at), copy, np.int32), first[at], W.signed(keys[at]))):
            c.append(x)
        # copies, as a view would keep all windows of its text
        columns[4] += [W.signed(each[a : b + 1].copy()) for a, b in zip(first[at].tolist(), last[at].tolist())]
        size += int((last[at] - first[at] + 1).sum())
        if size > 1_000_000:
            yield rows()
            columns, size = [[] for _ in _WINDOWS], 0
    if size:
        yield rows()


def _sketched_windows(bits):
    """Windows of the runs that a sketch of names has."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, copy, found in _texts(batches):
            first = found[0]
            of = [pa.array(np.full(len(first), doc)), pa.array(np.full(len(first), copy)), pa.array(first)]
            yield doc, copy, found, np.flatnonzero(_holds(bits.value, _names(of)))

    return lambda batches: _windows(marked(batches))


def _listed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the runs whose first words are listed beside the text."""

    def marked() -> Iterator[tuple]:
        for batch in batches:
            for doc, copy, raw, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), W.slices(batch.column(2)), batch.column(3).to_pylist()):
                found = runs(raw)
                yield doc, copy, found, np.flatnonzero(np.isin(found[0], firsts))

    return _windows(marked())


def _filtered(bits: np.ndarray, df: DataFrame, make, schema: str, label: str, rows: int | None = None) -> DataFrame:
    """What make(bits) lets through of a table, written."""
    sent = df.sparkSession.sparkContext.broadcast(bits)
    found = materialize(df.mapInArrow(make(sent), schema), label, rows=rows)
    sent.destroy()
    return found


def _owned_windows(texts: DataFrame, own: DataFrame, max_cells: int) -> DataFrame:
    """The windows of own runs (doc_id, copy, first), found again in the texts: by a sketch of their names if it
    isn't too large to be sent, otherwise by a join, which reads and shuffles only texts that have some."""
    n = own.count() * CELLS_PER_KEY
    if n > max_cells:
        lists = own.groupBy("doc_id", "copy").agg(F.collect_list("first").alias("firsts"))
        held = texts.join(lists, ["doc_id", "copy"]).select("doc_id", "copy", "text", "firsts")
        return materialize(held.mapInArrow(_listed_windows, _WINDOWS_SPARK), "windows", rows=TEXT_ROWS)
    width = max(MIN_CELLS, 1 << n.bit_length())
    return _filtered(sketch(own, min(max_cells, width), 1, True), texts, _sketched_windows, _WINDOWS_SPARK, "windows", TEXT_ROWS)


def repeated_spans(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, copy, spans): word spans (first, last) covered by windows that also start in a document
    of a smaller doc_id; last is exclusive, spans may overlap. copy is the hash of the text that has
    them, which tells the texts of one doc_id apart."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.hash("text").alias("copy"), "text")
    every = materialize(texts.mapInArrow(_runs, _RUNS_SPARK), "runs", rows=TEXT_ROWS)
    parts = [_filtered(sketch(some.select("key", "doc_id", "copy"), width, 2), some, _passing, _RUNS_SPARK, "passing") for some, width in sliced(every, "key", max_cells)]
    found = reduce(DataFrame.union, parts)
    discard(every)
    owners = materialize(found.groupBy("key", "run").agg(F.min("doc_id").alias("owner")), "owners")
    placed = materialize(found.join(owners, ["key", "run"]).select(*found.columns[:5], (F.col("owner") < F.col("doc_id")).alias("repeated")), "placed")
    several = materialize(owners.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
    discard(*parts, owners)
    # owners alone: any other holder of a run has a larger doc_id than its owner
    own = placed.where("not repeated").join(several, "key", "left_semi").select("doc_id", "copy", "first")
    own = materialize(own, "own")
    windows = _owned_windows(texts, own, max_cells)
    single = windows.select("doc_id", "copy", "key", F.posexplode("windows").alias("i", "window"), "first")
    single = single.select("key", "window", "doc_id", "copy", (F.col("first") + F.col("i")).alias("first"))
    least = single.groupBy("key", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most")
    least = materialize(least.select("key", "window", "owner"), "repeats")
    partly = single.join(least, ["key", "window"]).where("owner < doc_id").select("doc_id", "copy", "first", (F.col("first") + WINDOW).alias("last"))
    whole = placed.where("repeated").select("doc_id", "copy", "first", (F.col("last") + WINDOW).alias("last"))
    spans = whole.union(partly).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = materialize(spans, "spans")
    discard(placed, several, own, least, windows)
    return spans


_WORD = re.compile("[^ \t\n\v\f\r]+")


def kept_words(text: str, spans: list[tuple[int, int]]) -> tuple[int, list[str]]:
    """How many words the text has, and those outside the spans."""
    found = _WORD.findall(text)
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out += found[at:a]
        at = max(at, b)
    return len(found), out + found[at:]


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
_KEPT_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


#: Texts that are Python strings at a time.
_KEPT_ROWS = 200


@F.arrow_udf(_KEPT)
def _keep(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
    parts = [pa.array([], _KEPT_ARROW)]
    for at in range(0, len(texts), _KEPT_ROWS):
        rows = []
        for x, a, b in zip(*(c.slice(at, _KEPT_ROWS).to_pylist() for c in (texts, firsts, lasts))):
            n, kept = kept_words(x or "", list(zip(a or (), b or ())))
            rows.append({"n_words": n, "n_removed": n - len(kept), "kept": " ".join(kept)})
        parts.append(pa.array(rows, _KEPT_ARROW))
    return pa.concat_arrays(parts)


def deduplicate(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with n_words, n_removed and kept, the words left, joined by one space. Runs its jobs up to
    the last join when it is called; max_cells bounds what is broadcast (a quarter of a byte each).

    Removed is each word covered by a 50-word window whose word sequence also starts in a document
    with a smaller doc_id, judged on the texts as they come. Words are runs between ASCII white
    space, unchanged. Null, empty and blank texts have no words. Rows with one doc_id aren't compared
    with each other, whether their texts are equal or not, and each has its own words removed; a null
    doc_id is compared with nothing. Columns of these names are replaced, others stay, an empty table
    gives no rows."""
    docs = docs.drop("n_words", "n_removed", "kept").withColumn("text", F.col("text").cast("string"))
    doc, copy, spans, kept = (scratch(docs, x) for x in ("doc", "copy", "spans", "kept_words"))
    found = repeated_spans(docs, max_cells).toDF(doc, copy, spans)
    joined = docs.join(found, (F.col("doc_id") == F.col(doc)) & (F.hash("text") == F.col(copy)), "left")
    joined = joined.withColumn(kept, _keep("text", F.col(spans)["first"], F.col(spans)["last"]))
    return joined.select(*docs.columns, F.col(kept)["n_words"].alias("n_words"), F.col(kept)["n_removed"].alias("n_removed"), F.col(kept)["kept"].alias("kept"))

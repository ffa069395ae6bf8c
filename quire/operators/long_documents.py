"""Fence states and list numbers of documents that are too long for one task: lines as rows, in chunks.

A chunk's lines are read without knowing what came before, and summed up as what they do to any state before
them. The summaries, one small row per chunk, are put together in order; then each chunk is read once more from the
state it really begins with. No task holds more of a document than a chunk and its summaries."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .blocks import item_threshold, numbered_item
from .lines import FenceState, fence_line

#: Lines of one chunk.
CHUNK = 65_536
Open = tuple[str, int, int]  # mark, length, quote depth


def in_chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (doc_id, line_no, line) with chunk, the number of their chunk."""
    return rows.withColumn("chunk", F.floor(F.col("line_no") / size))


class Transition:
    """What a chunk does to a fence state: where any open block would end, and what follows from there.

    drops are the places where the quote depth gets less than ever before; closers, by mark and depth, those of
    closing fences longer than any before. So the first place that ends a block of given mark, length and depth is among
    them, whatever these are."""

    def __init__(self, lines: list[str]):
        self.events = []
        for i, line in enumerate(lines):
            depth, found = fence_line(line)
            self.events.append((i, depth, found))
        self.known: dict[int, tuple[Open | None, int]] = {}
        drops, closers, least = [], {}, None
        for i, depth, found in self.events:
            if least is None or depth < least:
                least = depth
                drops.append((depth, i))
            if found and found[2]:
                steps = closers.setdefault((found[0], depth), [])
                if not steps or steps[-1][0] < found[1]:
                    steps.append((found[1], i))
        self.fresh = self.after(0)
        self.drops = [(d, i, self.after(i)) for d, i in drops]
        self.closers = [(c, d, [(n, i, self.after(i + 1)) for n, i in steps]) for (c, d), steps in closers.items()]

    def after(self, start: int) -> tuple[Open | None, int]:
        """(state at the end, blocks begun) if no block is open before line start."""
        path, opened, at, state = [], [], start, None
        while at < len(self.events) and at not in self.known:
            path.append((at, len(opened)))
            while at < len(self.events) and not self.events[at][2]:
                at += 1
            if at == len(self.events):
                break
            _, depth, (mark, size, _) = self.events[at]
            state = (mark, size, depth)
            opened.append(at)
            at += 1
            while at < len(self.events):
                _, depth, found = self.events[at]
                if depth < state[2]:
                    state = None
                    break
                at += 1
                if found and depth == state[2] and found[0] == state[0] and found[1] >= state[1] and found[2]:
                    state = None
                    break
        end, more = self.known.get(at, (state, 0)) if state is None else (state, 0)
        for place, before in path:
            self.known[place] = (end, len(opened) - before + more)
        return end, len(opened) + more

    def summary(self) -> str:
        return json.dumps([self.fresh, self.drops, self.closers])


def applied(summary: list, state: Open | None) -> tuple[Open | None, int]:
    """The state behind a chunk and how many blocks begin in it, from the state before it."""
    fresh, drops, closers = summary
    if state is None:
        return (tuple(fresh[0]) if fresh[0] else None), fresh[1]
    mark, size, depth = state
    ends = [(i, after) for d, i, after in drops if d < depth][:1]
    ends += [next((i, after) for n, i, after in steps if n >= size) for c, d, steps in closers if c == mark and d == depth and steps[-1][0] >= size]
    if not ends:
        return state, 0
    _, (end, begun) = min(ends)
    return (tuple(end) if end else None), begun


def _summaries(group: pa.Table) -> pa.Table:
    ordered = group.sort_by("line_no")
    made = Transition([x or "" for x in ordered["line"].to_pylist()]).summary()
    return pa.table({"doc_id": ordered["doc_id"][:1], "chunk": ordered["chunk"][:1], "summary": [made]})


_ENTRIES = "doc_id {0}, chunk long, mark string, size int, depth int, block int"


def _entries(group: pa.Table) -> pa.Table:
    """The state before each chunk of a document, and the blocks before it."""
    ordered = group.sort_by("chunk")
    state, block, out = None, 0, []
    for text in ordered["summary"].to_pylist():
        out.append((*(state or (None, None, None)), block))
        state, begun = applied(json.loads(text), state)
        block += begun
    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
    return pa.table([ordered["doc_id"], ordered["chunk"], *columns], ["doc_id", "chunk", "mark", "size", "depth", "block"])


def _states(lines: pa.Table, entry: pa.Table) -> pa.Table:
    ordered = lines.sort_by("line_no")
    mark, size, depth, block = (entry[c][0].as_py() for c in ("mark", "size", "depth", "block"))
    state = FenceState()
    state.open, state.block = (mark, size, depth) if mark else None, block
    found = [state.read(x or "") for x in ordered["line"].to_pylist()]
    columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.bool_(), pa.bool_(), pa.bool_(), pa.int32()))]
    return pa.table([ordered["doc_id"], ordered["line_no"], ordered["line"], *columns], ["doc_id", "line_no", "line", "was_in", "marker", "is_in", "block"])


def fence_states(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (doc_id, line_no, line) with was_in, marker, is_in and block, as lines.fence_state() has them for arrays.
    Null lines count as empty; line numbers of a document are distinct; an empty table gives no rows."""
    dealt = in_chunks(rows.select("doc_id", F.col("line_no").cast("long"), "line"), size)
    kind = dict(dealt.dtypes)["doc_id"]
    sums = dealt.groupBy("doc_id", "chunk").applyInArrow(_summaries, f"doc_id {kind}, chunk long, summary string")
    entries = sums.groupBy("doc_id").applyInArrow(_entries, _ENTRIES.format(kind))
    entries = entries.select(*(F.col(c).alias(c if c not in ("doc_id", "chunk") else f"at_{c}") for c in entries.columns))
    out = f"doc_id {kind}, line_no long, line string, was_in boolean, marker boolean, is_in boolean, block int"
    return dealt.groupBy("doc_id", "chunk").cogroup(entries.groupBy("at_doc_id", "at_chunk")).applyInArrow(_states, out)


def renumber(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (doc_id, line_no, line) with ordered list items numbered from 1 at every indent, as
    blocks.renumber_lists() numbers them in arrays. Line numbers count from 0 without gaps.

    Within a chunk, items are counted since the last line that ends their list; what a chunk adds to the count of an
    indent, or whether it begins that anew, is summed up for the chunks behind it."""
    line = F.col("line")
    seen = in_chunks(fence_states(rows, size), size)
    seen = seen.withColumn("code", F.col("marker") | F.col("is_in"))
    blank = F.coalesce(X.is_blank(line) & ~F.col("marker"), F.lit(False))
    within = Window.partitionBy("doc_id", "chunk").orderBy("line_no")
    # the last line of a chunk stands before the first of the next
    last = seen.groupBy("doc_id", (F.col("chunk") + 1).alias("chunk")).agg(F.max_by(blank, "line_no").alias("blank_before"))
    seen = seen.withColumn("_before", F.lag(blank).over(within)).join(last, ["doc_id", "chunk"], "left")
    seen = seen.withColumn("_blank", F.coalesce("_before", "blank_before", F.lit(False)))
    item, indent, below = item_threshold(line, F.col("code"), F.col("_blank"))
    seen = seen.select("doc_id", "chunk", "line_no", "line", item.alias("item"), indent.alias("indent"), below.alias("below"))
    levels = seen.where("item").groupBy("doc_id").agg(F.collect_set("indent").alias("levels"))
    touched = F.filter("levels", lambda x: (F.col("item") & (x == F.col("indent"))) | (F.col("below") < x))
    events = seen.join(levels, "doc_id").select("doc_id", "chunk", "line_no", "item", "indent", F.explode(touched).alias("level"))
    events = events.withColumn("own", F.col("item") & (F.col("indent") == F.col("level")))
    by_chunk = Window.partitionBy("doc_id", "level", "chunk").orderBy("line_no")
    events = events.withColumn("list", F.sum((~F.col("own")).cast("long")).over(by_chunk))
    events = events.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "level", "chunk", "list", "own").orderBy("line_no")))
    # what each chunk leaves: items since its last end of a list, or all of them
    sums = events.groupBy("doc_id", "level", "chunk").agg(F.max("list").alias("ends"), F.max(F.struct("list", F.when(F.col("own"), F.col("place")).otherwise(0).alias("n"))).alias("tail"))
    over = Window.partitionBy("doc_id", "level").orderBy("chunk")
    sums = sums.withColumn("stretch", F.sum((F.col("ends") > 0).cast("long")).over(over))
    held = F.sum("tail.n").over(Window.partitionBy("doc_id", "level", "stretch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("held", held)
    sums = sums.select("doc_id", "level", "chunk", F.coalesce(F.lag("held").over(over), F.lit(0)).alias("carried"))
    numbers = events.where("own").join(sums, ["doc_id", "level", "chunk"])
    numbers = numbers.select("doc_id", "line_no", (F.col("place") + F.when(F.col("list") == 0, F.col("carried")).otherwise(0)).alias("number"))
    out = seen.select("doc_id", "line_no", "line").join(numbers, ["doc_id", "line_no"], "left")
    return out.select("doc_id", "line_no", F.when(F.col("number").isNotNull(), numbered_item(line, F.col("number"))).otherwise(line).alias("line"))

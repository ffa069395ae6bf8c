"""Periodic runs of words by the method of Gusfield and Stoye: squares from Lempel-Ziv blocks, the rest of
their vocabulary by suffix-link walks, and their occurrences from the leaves below, merged into runs.

A run is a stretch of words with smallest period q, at least LEAST_POWER periods and LEAST_WORDS words
long, that no neighbouring word extends. For such runs it is enough to look at stretches of words covered by
five-word sequences that come twice in a text (every five words of a run come again q words on or
back), and at squares of at most half of such a stretch. Within a stretch of n words:

1. a suffix tree is built (Ukkonen) and the stretch is cut into blocks, each the longest that began before;
2. for each block, the squares that are centred in it and those that begin in it and reach the next are
   found from common extensions at its edges (prefix tables, linear in the blocks): a set with
   the leftmost square of each group of rotations that follow each other;
3. bottom-up each node passes on the squares of its least leaf, so each finds its place in the tree;
4. from each place, suffix links lead to the place of the next rotation, until that is known or isn't there;
5. by growing period, the leaves below a place give the squares' starts. Those inside a run of a smaller period
   are powers of shorter ones. Starts that follow each other make one run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import with_fields

LEAST_POWER, LEAST_WORDS = 4, 6
#: Every sequence of so many words of a run comes again in it, one period on or back.
GRAM = 5


class SuffixTree:
    """Suffix tree of a list of numbers >= 0 with an end mark; nodes are numbered from the root, 0."""

    def __init__(self, text: list[int]):
        self.text = text = [*text, -1]
        n = len(text)
        start, end, link, edges = [0], [0], [0], [{}]
        leaf = n
        node = edge = length = pending = 0
        for i, c in enumerate(text):
            pending += 1
            last = 0
            while pending:
                if not length:
                    edge = i
                below = edges[node]
                child = below.get(text[edge])
                if child is None:
                    below[text[edge]] = len(start)
                    start.append(i)
                    end.append(leaf)
                    link.append(0)
                    edges.append(None)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = end[child] - start[child] if end[child] < leaf else i + 1 - start[child]
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if text[start[child] + length] == c:
                        if last and node:
                            link[last] = node
                        length += 1
                        break
                    split, new = len(start), len(start) + 1
                    start += [start[child], i]
                    end += [start[child] + length, leaf]
                    link += [0, 0]
                    edges += [{text[start[child] + length]: child, c: new}, None]
                    below[text[edge]] = split
                    start[child] += length
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if not node and length:
                    length -= 1
                    edge = i - pending + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.link, self.edges = start, end, link, edges
        self._walk()

    def _walk(self) -> None:
        """Parents, depths, and for each node its leaves' place in leaf order and the least of them."""
        start, end, edges, n = self.start, self.end, self.edges, len(self.text)
        count = len(start)
        parent, depth = [-1] * count, [0] * count
        order, stack = [], [0]
        while stack:
            v = stack.pop()
            order.append(v)
            below = edges[v]
            if below:
                d = depth[v]
                for u in below.values():
                    parent[u] = v
                    depth[u] = d + end[u] - start[u]
                    stack.append(u)
        low, high, least, leaves = [0] * count, [0] * count, [n] * count, []
        for v in order:
            low[v] = len(leaves)
            if edges[v] is None:
                least[v] = n - depth[v]
                leaves.append(n - depth[v])
            high[v] = len(leaves)
        for v in reversed(order):
            p = parent[v]
            if p >= 0:
                if high[v] > high[p]:
                    high[p] = high[v]
                if least[v] < least[p]:
                    least[p] = least[v]
        self.parent, self.depth, self.order = parent, depth, order
        self.low, self.high, self.least, self.leaves = low, high, least, leaves

    def blocks(self) -> list[int]:
        """Where the blocks of the text begin, and its end: each is the longest stretch that also begins
        before, or one new word."""
        text, edges, least, start, end = self.text, self.edges, self.least, self.start, self.end
        n, at, out = len(text) - 1, 0, [0]
        while at < n:
            v, size = 0, 0
            while at + size < n:
                child = edges[v].get(text[at + size]) if edges[v] else None
                if child is None or least[child] >= at:
                    break
                a, b = start[child], end[child]
                matched = 0
                while matched < b - a and at + size + matched < n and text[a + matched] == text[at + size + matched]:
                    matched += 1
                size += matched
                if matched < b - a:
                    break
                v = child
            at += max(size, 1)
            out.append(at)
        return out


def prefix_table(x: list[int]) -> list[int]:
    """How many items the list shares with each of its tails (the whole length at 0)."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k >= right - i:
                k = right - i
            else:
                z[i] = k
                continue
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def covering_squares(text: list[int], cuts: list[int], most: int) -> dict[int, set[int]]:
    """Start -> periods, at most `most`, of squares among which is the leftmost of each group of rotations
    that follow each other. cuts are the blocks' edges."""
    found: dict[int, set[int]] = {}
    n = len(text)
    for b in range(len(cuts) - 1):
        h, h1 = cuts[b], cuts[b + 1]
        h2 = cuts[b + 2] if b + 2 < len(cuts) else h1
        # centred in the block, the second half's edge behind it: compared at its end
        size = min(h1 - h, most)
        if h1 < n and size:
            far = min(n, h1 + size)
            ahead = prefix_table(text[h1:far] + [-2] + text[h1 - size : far])
            skip = far - h1 + 1
            back = prefix_table(text[max(0, h1 - 2 * size) : h1][::-1])
            for k in range(1, size + 1):
                k1 = ahead[skip + size - k]
                if not k1:
                    continue
                k2 = back[k] if k < len(back) else 0
                if k1 + k2 >= k:
                    q = h1 - k
                    found.setdefault(max(q - k2, q - k + 1), set()).add(k)
        # begun in the block or before it, the centre in it or the next one: compared at its start
        size = min(h2 - h, most)
        if h and size:
            ahead = prefix_table(text[h : min(n, h + 2 * size)])
            first = max(0, h - size)
            before = prefix_table(text[first:h][::-1] + [-2] + text[first : min(n, h + size)][::-1])
            skip, top = h - first + 1, min(n, h + size) - 1
            for k in range(1, size + 1):
                q = h + k
                if q >= n + 1 or q - 1 > top:
                    break
                k1 = ahead[k] if k < len(ahead) else 0
                k2 = before[skip + top - (q - 1)]
                if k1 and k2 and k1 + k2 >= k:
                    found.setdefault(max(h - k2, h - k + 1), set()).add(k)
                elif k1 >= k:
                    found.setdefault(h, set()).add(k)
        elif not h and size:
            ahead = prefix_table(text[: min(n, 2 * size)])
            for k in range(1, min(size, len(ahead) - 1) + 1):
                if ahead[k] >= k:
                    found.setdefault(0, set()).add(k)
    return found


def vocabulary(tree: SuffixTree, most: int) -> dict[int, set[int]]:
    """Period, at most `most`, -> the nodes at or just below the ends of all squares of that period."""
    text, depth, parent, edges, link = tree.text, tree.depth, tree.parent, tree.edges, tree.link
    squares = covering_squares(text[:-1], tree.blocks(), most)
    # bottom-up: a node hands on what its least leaf has left, longest first
    left: dict[int, list[int]] = {}
    marks: set[tuple[int, int]] = set()
    for v in reversed(tree.order):
        waiting = sorted(squares.get(tree.least[v], ())) if edges[v] is None else left.pop(v, ())
        p = parent[v]
        if p < 0:
            continue
        while waiting and 2 * waiting[-1] > depth[p]:
            marks.add((v, waiting.pop()))
        if waiting and tree.least[p] == tree.least[v]:
            left[p] = waiting
    # suffix-link walks to the rotations
    known: dict[int, set[int]] = {}
    todo = list(marks)
    for v, q in todo:
        known.setdefault(q, set()).add(v)
    start, end = tree.start, tree.end
    for v, q in todo:
        while True:
            size = 2 * q
            # an occurrence of the square begins at `at`; its tail without the first word is found from the link
            at = tree.least[v]
            first = text[at]
            p = parent[v]
            node = link[p] if p else 0
            goal = size - 1
            done = depth[node]
            below = None
            while done < goal:
                below = edges[node][text[at + 1 + done]]
                step = end[below] - start[below]
                if done + step > goal:
                    break
                node, done, below = below, done + step, None
            if done == goal:
                below = edges[node].get(first) if edges[node] else None
                if below is None:
                    break
            elif text[start[below] + goal - done] != first:
                break
            v = below
            if v in known[q]:
                break
            known[q].add(v)
    return known


def stretch_runs(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of numbers, by start, then period."""
    n = len(text)
    most = n // LEAST_POWER
    if n < LEAST_WORDS or most < 1:
        return []
    tree = SuffixTree(text)
    places = vocabulary(tree, most)
    leaves = np.array(tree.leaves)
    reach = np.zeros(n, np.int64)
    out = []
    for q in sorted(places):
        least = max(LEAST_WORDS, LEAST_POWER * q)
        starts = [leaves[tree.low[v] : tree.high[v]] for v in places[q] if reach[tree.least[v]] < tree.least[v] + 2 * q]
        if not starts:
            continue
        at = np.sort(np.concatenate(starts))
        edge = np.flatnonzero(np.diff(at) != 1) + 1
        begins = at[np.concatenate(([0], edge))]
        lengths = at[np.concatenate((edge - 1, [len(at) - 1]))] + 2 * q - begins
        for s, size in zip(begins.tolist(), lengths.tolist()):
            if size >= LEAST_POWER * q:
                part = reach[s : s + size]
                np.maximum(part, s + size, out=part)
                if size >= least:
                    out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(hashes: np.ndarray, numbered: Callable[[int, int], list[int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period. Equal items have equal hashes;
    numbered(a, b) gives numbers, the same for equal items only, of those from a to b."""
    if len(hashes) < LEAST_WORDS:
        return []
    _, inverse, counts = np.unique(W.windows(hashes, GRAM), return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return []
    out = []
    for part in np.split(again, np.flatnonzero(np.diff(again) > 1) + 1):
        a, b = int(part[0]), int(part[-1]) + GRAM
        if b - a >= LEAST_WORDS:
            out += [(a + s, size, q) for s, size, q in stretch_runs(numbered(a, b))]
    return sorted(out, key=lambda r: (r[0], r[2]))


_WORD = re.compile(rb"[^ \t\n\v\f\r]+")
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.string())])
_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))),
        T.StructField("collapsed", T.StringType()),
    ]
)


def described(raw: np.ndarray | None) -> dict:
    """What periodic_runs() says of one text, given its bytes."""
    if raw is None or not len(raw):
        return {"n_words": 0, "runs": [], "collapsed": ""}
    starts, ends, h = W.words(raw)
    whole = raw.tobytes()

    def numbered(a: int, b: int) -> list[int]:
        known: dict[bytes, int] = {}
        return [known.setdefault(whole[i:j], len(known)) for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist())]

    found = runs(h, numbered)
    kept = np.ones(len(starts), bool)
    for s, size, q in found:
        kept[s + q : s + size] = False
    text = b" ".join(_WORD.findall(whole) if kept.all() else [whole[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist())])
    return {"n_words": len(starts), "runs": [{"start": s, "length": size, "period": q} for s, size, q in found], "collapsed": text.decode()}


@F.arrow_udf(_SCHEMA)
def _describe(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([described(raw) for raw in W.slices(column)], _ARROW)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (structs of the first word's number, length and period in words, by start, then
    period) and collapsed (the text without the words of runs after their first period, words joined by
    one space) of their texts, cut into words at ASCII blanks.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Runs may overlap; a word
    goes if any run drops it. Other columns stay, columns of these names are replaced, repeated rows are
    treated each, very long texts whole (time and memory in proportion to their words, but for sorting), an empty table gives
    no rows."""
    return with_fields(docs, ["n_words", "runs", "collapsed"], _describe(F.col("text").cast("string")))

"""Packing token ids into sequences of fixed length by an order-preserving dynamic program.

Each task packs the documents of its own input partition in stored order: no shuffle, and the only
sequence not chosen by the program is the last of a partition. Window cuts may fall at document
ends (free), sentence ends (a small penalty) and, inside sentences of over HARD_GAP tokens, at every
HARD_STEP tokens (a larger one). With f(j) the least cost of cutting at candidate j,

    f(j) = min over i with t(j) - t(i) <= length of  f(i) + length - (t(j) - t(i)) + penalty(j),

so f(i) + t(i) is what is compared, and a monotone queue holds its minimum over the moving range.
The program runs over blocks of BLOCK tokens; the last window of a block is carried into the next.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

LENGTH, END_ID = 2048, 1
SENTENCE_PENALTY, HARD_PENALTY, HARD_GAP, HARD_STEP = 2, 6, 64, 32
BLOCK = 1 << 20
#: Bytes of text met at once; slots of the piece table, a power of two.
GROUP, SLOTS = 1 << 19, 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

_SPACE, _ALNUM, _SIGN, _GLUE = 0, 1, 2, 4
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = _SPACE
_CLASS[[x for x in range(128) if chr(x).isalnum()]] = _ALNUM
_CLASS[[*range(128, 256), ord("'")]] = _GLUE
_MARK = np.zeros(256, bool)
_MARK[list(b".!?")] = True
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


class PieceTokens:
    """Token ids of texts through a table of pieces, looked up by 64-bit hashes in numpy. The bytes of
    what is found are compared, so that pieces whose hashes collide get their own ids all the same.

    The tokenizer drops white space, lowers case and never merges over white space, nor between an
    ASCII letter or digit and an ASCII sign other than the apostrophe; the stretches between such
    places are the pieces, and each distinct one is encoded once. Lowering A-Z first is skipped near
    combining marks, where it need not commute with composition. Texts that name special tokens are
    encoded whole. The table is emptied when half full, which only costs time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.first, self.size, self.known = np.zeros(SLOTS // 2, np.int64), np.zeros(SLOTS // 2, np.int64), 0
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.text, self.text_first, self.text_size, self.text_used = np.zeros(1 << 20, np.uint8), self.first.copy(), self.first.copy(), 0

    def places_of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for an unknown one."""
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        got = self.keys[slot]
        at = np.flatnonzero((got != keys) & (got != 0))
        while len(at):
            slot[at] = (slot[at] + 1) & (SLOTS - 1)
            got = self.keys[slot[at]]
            at = at[(got != keys[at]) & (got != 0)]
        return self.places[slot]

    def _insert(self, keys: np.ndarray) -> None:
        """Give distinct unknown keys the next places."""
        slot, at = (keys & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(keys))
        while len(at):
            free = at[self.keys[slot[at]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            one = free[one]
            self.keys[slot[one]] = keys[one]
            self.places[slot[one]] = self.known + one
            at = at[self.keys[slot[at]] != keys[at]]
            slot[at] = (slot[at] + 1) & (SLOTS - 1)

    def learn(self, keys: np.ndarray | None, pieces: list[str], texts: list[bytes]) -> None:
        """Make distinct unknown keys known, with the ids and compared bytes of their pieces; without
        keys the pieces only take the next places, in their order."""
        plain = np.array([x.isalpha() and (x.isascii() or max(x) < "\u0250") for x in pieces]) & (keys is not None)
        ids, sizes = np.empty(0, np.uint32), np.empty(0, np.int64)
        if plain.any():  # a plain piece is one word of the tokenizer, so its ids end with the next word end
            words = " ".join([x for x, p in zip(pieces, plain.tolist()) if p])
            ids = np.array(self.tokenizer.encode_batch_fast([words], add_special_tokens=False)[0].ids, np.uint32)
            sizes = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
            if len(sizes) != plain.sum():
                ids, sizes, plain[:] = ids[:0], sizes[:0], False
        rest = [x for x, p in zip(pieces, plain.tolist()) if not p]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        ids = np.concatenate((ids, *(np.array(x, np.uint32) for x in rest)))
        sizes = np.concatenate((sizes, np.array([len(x) for x in rest], np.int64)))
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        data = np.frombuffer(b"".join([texts[i] for i in order.tolist()]), np.uint8)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.text_used + len(data) > len(self.text):
            self.text = np.concatenate((self.text, np.zeros_like(self.text)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.text[self.text_used : self.text_used + len(data)] = data
        if keys is not None:
            self._insert(keys[order])
        new = slice(self.known, self.known + len(pieces))
        if new.stop > len(self.first):
            for name in ("first", "size", "text_first", "text_size"):
                setattr(self, name, np.concatenate((getattr(self, name), np.zeros(new.stop, np.int64))))
        self.size[new], self.first[new] = sizes, self.used + np.cumsum(sizes) - sizes
        sizes = np.array([len(texts[i]) for i in order.tolist()], np.int64)
        self.text_size[new], self.text_first[new] = sizes, self.text_used + np.cumsum(sizes) - sizes
        self.used, self.text_used, self.known = self.used + len(ids), self.text_used + len(data), new.stop

    @staticmethod
    def _pieces(raw: np.ndarray, starts: np.ndarray, data: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[list[str], list[bytes]]:
        """Some pieces as text, and their bytes as they are compared."""
        whole, known, n = raw.tobytes(), data.tobytes(), sizes[at].tolist()
        first = (np.cumsum(sizes) - sizes)[at].tolist()
        return [whole[a : a + k].decode() for a, k in zip(starts[at].tolist(), n)], [known[a : a + k] for a, k in zip(first, n)]

    def _others(self, place: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which pieces, in a row in data, have other bytes than those of their places."""
        first = np.cumsum(sizes) - sizes
        other = self.text_size[place] != sizes
        at = np.repeat(self.text_first[place] - first, sizes)
        at += np.arange(len(data))
        same = self.text.take(at, mode="clip") == data
        return np.flatnonzero(other | ~np.logical_and.reduceat(same, first) if not same.all() else other)

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the texts raw[bounds[i]:bounds[i+1]] in a row, where each text's ids begin (and
        the last end), and after how many ids sentences end. Texts begin and end between words."""
        kind = _CLASS[raw]
        step = kind[1:] ^ kind[:-1]
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = (step > 0) & (step < 5)
        cut[bounds] = True
        inside = kind != _SPACE
        starts, ends = np.flatnonzero(cut[:-1] & inside), np.flatnonzero(cut[1:] & inside) + 1
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64), np.empty(0, np.int64)
        sizes = ends - starts
        data = raw[inside]
        if not ((raw == 0xCC) | (raw == 0xCD)).any():  # combining marks
            data = W.LOWER[data]
        keys = np.maximum(W.hashed(data, sizes)[0], np.uint64(1))
        place = self.places_of(keys)
        if (place < 0).any():
            if self.known + len(keys) > SLOTS // 2:
                self.clear()
                place[:] = -1
            lost = np.flatnonzero(place < 0)
            new, one = np.unique(keys[lost], return_index=True)
            self.learn(new, *self._pieces(raw, starts, data, sizes, lost[one]))
            place[lost] = self.places_of(keys[lost])
        if len(other := self._others(place, data, sizes)):
            place[other] = self.known + np.arange(len(other))
            self.learn(None, *self._pieces(raw, starts, data, sizes, other))
        size = self.size[place]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.first[place] - total[:-1], size) + np.arange(total[-1])]
        # a sentence ends at a single mark before white space, or at a line break
        mark = _MARK[raw[ends - 1]] & ~_MARK[raw[np.maximum(ends - 2, 0)]]
        lines = np.flatnonzero((raw == 10) | (raw == 13))
        broken = np.diff(np.searchsorted(lines, starts), append=len(lines)) > 0
        spaced = np.ones(len(ends), bool)
        spaced[:-1] = starts[1:] > ends[:-1]
        return ids, total[np.searchsorted(starts, bounds)], total[1:][spaced & (mark | broken)]


_loaded: dict[str, PieceTokens] = {}


def piece_tokens(path: str) -> PieceTokens:
    if path not in _loaded:
        _loaded[path] = PieceTokens(path)
    return _loaded[path]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions and penalties of the places where a stream of ids may be cut, by position."""
    at = np.union1d(doc_ends, sentence_ends)
    free = np.isin(at, doc_ends, assume_unique=True)
    before = np.concatenate(([0], at[:-1]))
    gap = at - before
    hard = np.where(gap > HARD_GAP, (gap - 1) // HARD_STEP, 0)
    penalty = np.where(free, 0, SENTENCE_PENALTY)
    if hard.any():
        first = np.repeat(np.cumsum(hard) - hard, hard)
        inner = np.repeat(before, hard) + HARD_STEP * (np.arange(len(first)) - first + 1)
        at = np.concatenate((at, inner))
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], np.concatenate((penalty, np.full(len(inner), HARD_PENALTY)))[order]
    return at.tolist(), penalty.tolist()


def cuts(points: list[tuple[int, int]], length: int = LENGTH) -> list[int]:
    """The positions of the cheapest cuts, the last point included; points are (position, penalty)
    by position, at most length apart."""
    queue: deque[tuple[int, int]] = deque([(0, -1)])  # (f + t, index), both increasing
    at, back = [t for t, _ in points], []
    for j, (t, penalty) in enumerate(points):
        while t - (at[queue[0][1]] if queue[0][1] >= 0 else 0) > length:
            queue.popleft()
        best, i = queue[0]
        back.append(i)
        key = best + length + penalty  # f(j) + t(j)
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(points) - 1
    while j >= 0:
        out.append(at[j])
        j = back[j]
    return out[::-1]


class _Packer:
    """Documents not yet written, and the candidate cuts behind the last written id."""

    def __init__(self, first_sequence: int):
        self.sequence, self.size = first_sequence, 0
        self.docs: deque[list] = deque()  # [doc_id, ids, ids written]
        self.at: list[int] = []
        self.penalty: list[int] = []

    def add(self, docs: list[tuple[int, bytes]], sentence_ends: np.ndarray) -> None:
        """More documents; sentence_ends counts the ids from the first of them, END_ID included."""
        self.docs.extend([i, ids, 0] for i, ids in docs)
        doc_ends = np.cumsum([len(ids) // 4 for _, ids in docs])
        at, penalty = candidates(doc_ends, sentence_ends)
        self.at += [self.size + t for t in at]
        self.penalty += penalty
        self.size += int(doc_ends[-1])

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the chosen windows, without the last window unless last."""
        rows, found, at = [], cuts(list(zip(self.at, self.penalty))) if self.at else [], 0
        for end in found if last else found[:-1]:
            offset = 0
            while at < end:
                doc = self.docs[0]
                n = len(doc[1]) // 4
                take = min(n - doc[2], end - at)
                part = memoryview(doc[1])[4 * doc[2] : 4 * (doc[2] + take)]
                rows.append((doc[0], doc[2], take, zlib.crc32(part), n, self.sequence, offset))
                doc[2] += take
                at, offset = at + take, offset + take
                if doc[2] == n:
                    self.docs.popleft()
            self.sequence += 1
        gone = bisect_right(self.at, at)
        self.at, self.penalty = [t - at for t in self.at[gone:]], self.penalty[gone:]
        self.size -= at
        return rows


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about GROUP bytes that end with white space."""
    at = 0
    while len(raw) - at > 2 * GROUP:
        end, look = at + GROUP, 1 << 12
        while end < len(raw) and not len(gaps := np.flatnonzero(_CLASS[raw[end : end + look]] == _SPACE)):
            end += look
        if end >= len(raw):
            break
        end += int(gaps[0]) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


_END = END_ID.to_bytes(4, "little")


def encoded(tokens: PieceTokens, texts: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """The ids of each text with END_ID, and after how many of all these ids sentences end."""
    if len(texts) == 1:
        ids, ends, size = [], [], 0
        for part in _parts(texts[0]):
            x, _, e = tokens.encode(part, np.array([0, len(part)]))
            ids.append(x.tobytes())
            ends.append(e + size)
            size += len(x)
        return [b"".join([*ids, _END])], np.concatenate(ends)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    ids, begins, ends = tokens.encode(np.concatenate(texts), bounds)
    data, places = ids.tobytes(), (4 * begins).tolist()
    # every document before the one that a sentence ends in has an END_ID of its own
    ends = ends + np.searchsorted(begins[1:], ends)
    return [data[a:b] + _END for a, b in zip(places, places[1:])], ends


def _pack(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = piece_tokens(path)
        packer = _Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=_ARROW)

        def add(ids, texts):
            data, ends = encoded(tokens, texts)
            packer.add(list(zip(ids, data)), ends)
            return packer.size >= BLOCK and packer.flush(False)

        def some(batch):
            ids, texts, size = [], [], 0
            for i, raw in zip(batch.column("doc_id").to_pylist(), W.slices(batch.column("text"))):
                data = raw.tobytes()
                if b"<|" in data and any(x in data for x in _SPECIAL):
                    if ids:
                        yield add(ids, texts)
                        ids, texts, size = [], [], 0
                    whole = np.array(tokens.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                    packer.add([(i, whole + _END)], np.empty(0, np.int64))
                    continue
                if ids and size + len(raw) > GROUP:
                    yield add(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(raw)
                size += len(raw)
            if ids:
                yield add(ids, texts)

        for batch in batches:
            for found in some(batch):
                if found:
                    yield rows(found)
        if found := packer.flush(True):
            yield rows(found)

    return task


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of the documents' ids (word tokens, then END_ID) in sequences of at most LENGTH ids.

    Takes doc_id and text; other columns are left out. A null or empty text, or one of white space,
    is one piece of END_ID alone. Repeated rows are packed as often as they occur. A null doc_id
    stays null. An empty table gives no rows. Very long texts are cut at sentences, or inside
    sentences where none ends in time; every id lies in exactly one piece."""
    texts = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", texts).mapInArrow(_pack(tokenizer_path), SCHEMA)

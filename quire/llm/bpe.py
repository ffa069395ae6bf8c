"""Byte-level BPE, encoded and decoded: merges of a pre-token found by a segment tree over its pairs.

The leaves of the tree are the pairs of neighbouring symbols, each with the rank of its merge and its
place in one number, so that the least leaf under the root is the leftmost pair of the lowest rank. A
merge changes at most three leaves (its own, and the pairs before and behind), each with the path above it, up
to where the least value stays the same. When the root holds no rank, no pair can be merged any more.
The trees of many short pre-tokens of about one length are rows of one array, so that each step merges in all of
them; longer ones have a tree of their own. Distinct pre-tokens are encoded once for as long as a bounded cache
holds them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import with_fields

#: Pre-tokens, and bytes of them and their ids, beyond which a task forgets those of earlier texts.
CACHED, CACHED_BYTES = 200_000, 1 << 25
#: Characters of texts that are encoded together; pre-tokens whose trees are rows of one array, and bytes of the
#: longest of these.
CHUNK, ROWS, SHORT = 1 << 19, 2048, 64
#: Fixed: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes in turn for those from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


def merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges; ranks gives (rank, new symbol) of a pair."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = [*symbols]
    get = ranks.get
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found is not None:
            tree[size + i] = found[0] << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                break
            tree[k] = value

    def rank(i: int) -> int:
        j = after[i]
        found = get((symbols[i], symbols[j])) if j < n else None
        return _NONE if found is None else found[0] << 32 | i

    while (least := tree[1]) < _NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            put(j, _NONE)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    return [x for x in symbols if x >= 0]


class Merges:
    """The merges of a vocabulary for arrays: rank of a pair of symbols, and the symbol that it gives."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        self.rank = np.argsort(keys)
        self.keys = np.append(keys[self.rank], -1)
        self.rank = np.append(self.rank, 0)
        self.made = table[:, 2]

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the tree for pairs of symbols at given places; symbols below 0 make none."""
        keys = np.where((a >= 0) & (b >= 0), a << 32 | b, -2)
        found = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[found] == keys, self.rank[found] << 32 | at, _NONE)


def merged_rows(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """The rows of an array of symbols, filled up with -1, after all merges; symbols that went are -1."""
    count, n = symbols.shape
    symbols = np.concatenate((symbols, np.full((count, 1), -1)), 1)
    size = 1 << max(0, n - 2).bit_length()
    tree = np.full((count, 2 * size), _NONE)
    tree[:, size : size + n - 1] = merges.leaves(symbols[:, : n - 1], symbols[:, 1:n], np.arange(n - 1))
    half = size // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    # place n stands for none behind, and (as -1) before
    after = np.tile(np.append(np.arange(1, n + 1), n), (count, 1))
    before = np.tile(np.arange(-1, n), (count, 1))
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        least = tree[rows, 1]
        i = least & 0xFFFFFFFF
        j = after[rows, i]
        k = after[rows, j]
        new = merges.made[least >> 32]
        symbols[rows, i] = new
        symbols[rows, j] = -1
        after[rows, i] = k
        before[rows, k] = i
        h = before[rows, i]
        changed = [size + np.minimum(j, size - 1), size + i, size + np.where(h < 0, i, h)]
        tree[rows, changed[0]] = _NONE
        left = merges.leaves(symbols[rows, h], new, h)
        tree[rows, changed[1]] = right = merges.leaves(new, symbols[rows, k], i)
        tree[rows, changed[2]] = np.where(h < 0, right, left)
        for _ in range(size.bit_length() - 1):
            changed = [at >> 1 for at in changed]
            for at in changed:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        rows = rows[tree[rows, 1] < _NONE]
    return symbols[:, :n]


class Vocabulary:
    """A byte-level BPE vocabulary from a file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (spec["normalizer"] is None and model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and (spec["decoder"] or {}).get("type") == "ByteLevel"
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        whole = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if not plain or not whole:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        letters, ids = byte_letters(), model["vocab"]
        self.first = [ids[x] for x in letters]
        self.symbols = np.array(self.first, np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        to_byte = {x: b for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        # of two that begin at one place the longer one counts
        names = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda text: [text]
        self.pieces = regex.compile(PATTERN).findall
        self.path = path
        self.doubtful = None
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if not text.isascii():
            if self.doubtful is None:
                # letters and digits newer than the Unicode version that both libraries know
                import regex

                every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
                new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
                self.doubtful = frozenset(new)
            if not self.doubtful.isdisjoint(text):
                from tokenizers import pre_tokenizers

                rule = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
                return [text[a:b] for _, (a, b) in rule.pre_tokenize_str(text)]
        return self.pieces(text)

    def learn(self, words: set[str]) -> None:
        """Put the ids of new pre-tokens into the cache."""
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            sized.setdefault((max(len(raw), 2) - 2).bit_length(), []).append((word, raw))
        for bits, some in sized.items():
            for at in range(0, len(some), ROWS):
                part = some[at : at + ROWS]
                if 1 << bits > SHORT:
                    made = [np.array(merged([self.first[b] for b in raw], self.ranks), "<u4").tobytes() for _, raw in part]
                else:
                    made = self._rows([raw for _, raw in part])
                for (word, raw), ids in zip(part, made):
                    self.cache[word] = ids
                    self.held += len(raw) + len(ids)

    def _rows(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array(list(map(len, words)))
        rows = np.full((len(words), max(2, int(sizes.max()))), -1)
        inside = np.arange(rows.shape[1]) < sizes[:, None]
        rows[inside] = self.symbols[np.frombuffer(b"".join(words), np.uint8)]
        rows = merged_rows(rows, self.merges)
        left = rows >= 0
        data, ends = rows[left].astype("<u4").tobytes(), np.cumsum(left.sum(1) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        # for each text the words of its parts, and special tokens between them as they are
        parts = [[p if p in self.special else self.words(p) for p in self.split(x) if p] for x in texts]
        words = {w for text in parts for p in text if type(p) is list for w in p}
        if len(self.cache) >= CACHED or self.held > CACHED_BYTES:
            self.cache.clear()
            self.held = 0
        self.learn(words.difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join([b"".join(map(get, p)) if type(p) is list else self.special[p].to_bytes(4, "little") for p in x]) for x in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        known, n = self.bytes, len(self.bytes)
        return b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, decoded: str | None = None) -> DataFrame:
    """docs with n_tokens and ids (a binary of little-endian unsigned 32-bit numbers) of their texts, as the
    tokenizers library encodes them with this file and without adding special tokens; the strings of
    special tokens within a text are these tokens. With a name for it, there is a column of the texts that the ids are
    decoded to as well, as decode() gives them, in the same pass.

    Null and empty texts have no ids (an empty binary), blank ones those of their blanks. Other columns stay,
    columns of these names are replaced, repeated rows are encoded each, very long texts and pre-tokens
    whole (n log n steps for a pre-token of n bytes), an empty table gives no rows."""
    kinds = [("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary()), (decoded, T.StringType(), pa.string())][: 3 if decoded else 2]

    @F.arrow_udf(T.StructType([T.StructField(name, kind) for name, kind, _ in kinds]))
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path)
        for column in columns:
            ids, chunk, size = [], [], 0
            for x in column:
                chunk.append(x.as_py() or "")
                size += len(chunk[-1])
                if size > CHUNK:
                    ids += known.encode_all(chunk)
                    chunk, size = [], 0
            ids += known.encode_all(chunk)
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                made.append(pa.array(map(known.decode, ids), pa.string()))
            yield pa.StructArray.from_arrays(made, [name for name, *_ in kinds])

    return with_fields(docs, [name for name, *_ in kinds], run(F.col("text").cast("string")))


def decode(encoded: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """encoded with the text of its column ids, special tokens included, as the tokenizers library decodes
    them: bytes that aren't UTF-8 become U+FFFD, ids that the file doesn't have give nothing.

    Null and empty ids give an empty text; a column of the new one's name is replaced; repeated rows are
    decoded each, an empty table gives no rows."""

    @F.arrow_udf(T.StringType())
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path)
        for column in columns:
            yield pa.array([known.decode(x.as_py() or b"") for x in column], pa.string())

    return encoded.withColumn(into, run(F.coalesce(F.col("ids"), F.lit(b""))))

"""Word and word-window hashes of UTF-8 texts, in numpy.

A word's hash adds up random 64-bit numbers, one for each pair of a place in the word and a byte, so
that any two different words collide with a probability of 2**-64, whatever their bytes; words longer
than the table of numbers (PLACES) take the two halves of a 128-bit xxh3 hash instead. The second hash
of words() comes from numbers (or a half) of its own: together they give 128 bits where equality has
to stand for equal words. A window's hash is a polynomial of its words' hashes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
PIECE = 1 << 16
BASE_A, BASE_B = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
#: Bytes of a word that have random numbers of their own.
PLACES = 64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(chars: bytes, keep: bool) -> np.ndarray:
    out = np.full(256, not keep)
    out[list(chars)] = keep
    return out


#: Words between white space: everything but space, tab, newline, vertical tab, form feed, return.
SPACED = _table(b" \t\n\v\f\r", False)
#: Words of ASCII letters and digits and of all non-ASCII characters.
ALNUM = _table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), True)
#: Bytes as they are, and with A-Z as a-z.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] = SAME[97:123]
#: The random numbers of the two word hashes, by place and byte.
_NUMBERS = np.random.default_rng(20).integers(0, 1 << 64, (2, PLACES * 256), np.uint64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) modulo 2**64 and their inverses; base is odd."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        known = _powers[base] = tuple(out)
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each text of a string column, without copying; None for null."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield None if valid is not None and not valid[i] else raw[ends[i] : ends[i + 1]]


def hashed(data: np.ndarray, sizes: np.ndarray, which: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """The hashes of byte strings that lie in a row in data: sizes says how long each is, at least 1."""
    first = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes > PLACES)
    place = np.arange(len(data)) - np.repeat(first, sizes)
    if len(long):
        place &= PLACES - 1
    place <<= 8
    place += data
    out = [np.add.reduceat(_NUMBERS[n][place], first) if len(sizes) else np.empty(0, np.uint64) for n in which]
    for i in long.tolist():
        whole = xxhash.xxh3_128_intdigest(data[first[i] : first[i] + sizes[i]].tobytes())
        for n, h in zip(which, out):
            h[i] = whole >> 64 * n & 0xFFFFFFFFFFFFFFFF
    return out


def _piece(raw: np.ndarray, is_word: np.ndarray, values: np.ndarray, which: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    inside = is_word[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    starts, ends = edge[::2], edge[1::2]
    data = raw[inside]
    return starts, ends, *hashed(data if values is SAME else values[data], ends - starts, which)


def words(raw: np.ndarray, is_word: np.ndarray = SPACED, lower: bool = False, which: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """Byte starts and ends of a text's words, and the wanted ones (which) of their two 64-bit hashes.
    Works in pieces of about PIECE bytes, cut between words, so that memory stays a small multiple of
    the text."""
    values = LOWER if lower else SAME
    out, at = [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw):
            gaps = np.flatnonzero(~is_word[raw[max(at, end - 4096) : end]])
            if len(gaps):
                end = max(at, end - 4096) + int(gaps[-1]) + 1
                break
            end = min(end + PIECE, len(raw))
        s, e, *h = _piece(raw[at:end], is_word, values, which)
        out.append((s + at, e + at, *h))
        at = end
    if not out:
        none = np.empty(0, np.int64)
        return none, none, *(np.empty(0, np.uint64) for _ in which)
    return tuple(np.concatenate(x) for x in zip(*out)) if len(out) > 1 else out[0]


def windows(h: np.ndarray, k: int, base: int = BASE_A) -> np.ndarray:
    """Hashes of each k consecutive values of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(base, len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix((total[k:] - total[:n]) * down[:n] + U(k))


def stretches(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of h that begin at starts, the first at 0, and end where the next begins."""
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(h)) - np.repeat(starts, np.diff(starts, append=len(h)))
    return mix(np.add.reduceat(mix(h ^ mix(place.astype(np.uint64) + U(1))), starts))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, h.dtype)
    size, x = 1, h
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)

"""Secrets in texts, with structural confirmation.

Base detection is three patterns. Beside them, long base64 and hex runs are decoded and reported
only if their bytes parse as what a secret looks like: DER private keys whose nested lengths fill
the bytes exactly, OpenSSH private keys with their length-prefixed fields, and signed tokens whose
header is a JSON object that names its algorithm. A base64 key may follow a slash or be wrapped over
lines: the outer length in its first bytes says how many characters belong to it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pii import Span, ordered, written
from .store import with_fields

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der_key", "ssh_key")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]++)")
#: Where base64 of a DER SEQUENCE or of the magic string of OpenSSH may begin, and how it goes on.
_START = re.compile(r"(?<![A-Za-z0-9+_-])(?:M[A-Za-z0-9+/_-]{11}|b3BlbnNzaC1rZXktdjE)")
_LINE = re.compile(r"[A-Za-z0-9+/_-]++")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*(?=[A-Za-z0-9+/_-])")
#: The longest line that wrapped base64 has in use.
LINE_WIDTH = 76
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----\s{0,8}([A-Za-z0-9+/=\s]{40,}+)")


def detect(text: str) -> list[Span]:
    """Base spans: leftmost, non-overlapping within a kind, failing matches dropped."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def unbase64(x: str) -> bytes | None:
    x = "".join(x.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(x + "=" * (-len(x) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER values that fill data exactly; None if the lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, PKCS#8, SEC 1 or traditional DSA private key: one SEQUENCE that begins with a small
    version number; or an encrypted PKCS#8 key, which begins with its scheme and the scheme's parameters."""
    if len(data) < 16 or data[0] != 0x30 or not (outer := der_items(data)) or len(outer) != 1:
        return False
    parts = der_items(outer[0][1])
    if not parts or len(parts) < 2:
        return False
    if [t for t, _ in parts] == [0x30, 0x04]:
        scheme = der_items(parts[0][1])
        return bool(scheme) and [t for t, _ in scheme] == [0x06, 0x30] and len(parts[1][1]) >= 16
    if parts[0][0] != 0x02 or parts[0][1] not in (b"\0", b"\1"):
        return False
    tags = [t for t, _ in parts]
    if len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags == [0x02] * 6:  # DSA: p is larger than q
        return len(parts[1][1]) > len(parts[2][1]) >= 16
    if tags[1] == 0x30 and len(parts) >= 3 and tags[2] == 0x04:
        return bool((names := der_items(parts[1][1])) and names[0][0] == 0x06)
    return tags[1] == 0x04 and len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])


#: Bytes that a name or an option in an OpenSSH key may have; the formats in use have less than 100.
FIELD = 1024
_MAGIC = b"openssh-key-v1\0"


def ssh_header(data: bytes) -> bool | None:
    """Whether data begins as a private key in OpenSSH's format: a magic string, three length-prefixed fields and a
    count. None if there is too little of it to tell."""
    if not data.startswith(_MAGIC):
        return None if _MAGIC.startswith(data) else False
    at = len(_MAGIC)
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        if len(data) < at + 4:
            return None
        if n > FIELD:
            return False
        at += 4 + n
    return None if len(data) < at + 4 else 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_ssh_key(data: bytes) -> bool:
    return ssh_header(data) is True


def is_signed_token(header: str, payload: str) -> bool:
    """Whether the header is a JSON object that names an algorithm, and the payload decodes too."""
    data = unbase64(header)
    if not data or not data.lstrip(b" \t\r\n").startswith(b"{"):
        return False
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(found.get("alg"), str) and unbase64(payload) is not None


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def _der_chars(text: str, start: int) -> int | None:
    """How many base64 characters, without padding, the DER SEQUENCE that begins there takes."""
    head = unbase64(text[start : start + 8])
    if not head or head[0] != 0x30:
        return None
    n, size = head[1], 0
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4:
            return None
        n = int.from_bytes(head[2 : 2 + size], "big")
    return -(-(2 + size + n) * 4 // 3)


class Lines:
    """The runs of base64 characters of a text, and how many of them there are before each; runs that only a line
    break parts belong to one chain. What a start needs is found by search, not by reading on."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.before, self.chains = text, [], [], [0], []
        for m in _LINE.finditer(text):
            linked = bool(self.ends) and (x := _BREAK.match(text, self.ends[-1])) is not None and x.end() == m.start()
            self.chains.append(self.chains[-1] if linked else len(self.starts))
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.before.append(self.before[-1] + m.end() - m.start())

    def by_length(self, start: int, chars: int) -> tuple[str, int] | None:
        """That many characters from start on, over line breaks, and the end of their padding, if a run ends there."""
        first = bisect_right(self.starts, start) - 1
        last = bisect_left(self.before, self.before[first] + start - self.starts[first] + chars) - 1
        if last >= len(self.starts) or self.chains[last] != self.chains[first]:
            return None
        if self.before[last + 1] - self.before[first] - (start - self.starts[first]) != chars:
            return None
        parts = [self.text[max(start, a) : b] for a, b in zip(self.starts[first : last + 1], self.ends[first : last + 1])]
        return "".join(parts), self._padded(self.ends[last])

    def by_lines(self, start: int) -> tuple[str, int] | None:
        """An OpenSSH key from start on: lines as long as the first and a shorter last one; a first one over
        LINE_WIDTH stands alone. None if its header doesn't hold, which its first lines tell."""
        first = last = bisect_right(self.starts, start) - 1
        width = self.ends[first] - start
        parts, known = [self.text[start : self.ends[first]]], None
        while width <= LINE_WIDTH and self.ends[last] - max(start, self.starts[last]) == width:
            if last + 1 == len(self.starts) or self.chains[last + 1] != self.chains[last] or self.ends[last + 1] - self.starts[last + 1] > width:
                break
            last += 1
            parts.append(self.text[self.starts[last] : self.ends[last]])
            if known is None:
                head = "".join(parts)
                known = ssh_header(unbase64(head[: len(head) // 4 * 4]) or b"")
                if known is False:
                    return None
        return "".join(parts), self._padded(self.ends[last])

    def _padded(self, end: int) -> int:
        at = end
        while end < len(self.text) and self.text[end] == "=" and end < at + 2:
            end += 1
        return end


def _wrapped(text: str) -> list[Span]:
    """Keys in base64 by the length that they name, or OpenSSH keys up to the end of their lines."""
    found, done, lines = [], 0, None
    for m in _START.finditer(text):
        start = m.start()
        if start < done:
            continue
        chars = None
        if m[0][0] == "M" and ((chars := _der_chars(text, start)) is None or chars > len(text) - start):
            continue
        lines = lines or Lines(text)
        got = lines.by_lines(start) if chars is None else lines.by_length(start, chars)
        if got and (kind := _key_kind(unbase64(got[0]))):
            found.append((kind, start, got[1]))
            done = got[1]
    return found


def _outside(found: set[Span]) -> Callable[[int, int], bool]:
    """Tells whether a stretch meets none of these spans."""
    spans = sorted((a, b) for _, a, b in found)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def free(a: int, b: int) -> bool:
        n = bisect_left(starts, b)
        return not n or reach[n - 1] <= a

    return free


def confirmed(text: str) -> set[Span]:
    """Spans of decoded candidates whose structure holds."""
    found: set[Span] = {("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2])}
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            if kind := _key_kind(unbase64(m[1])):
                found.add((kind, m.start(1), m.start(1) + len(m[1].rstrip())))
    # keys over several lines before runs, as the first line of an OpenSSH key may pass for a whole one
    free = _outside(found)
    found |= {x for x in _wrapped(text) if free(*x[1:])}
    free = _outside(found)
    for m in _RUN.finditer(text):
        run = m[0]
        kind = _key_kind(unbase64(run))
        if not kind and len(run) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", run):
            kind = _key_kind(bytes.fromhex(run))
        if kind and free(*m.span()):
            found.add((kind, *m.span()))
    return found


_SCHEMA = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [T.StructField(k, T.StringType()) for k in ("base", "spans")])
_ARROW = pa.struct([(f"n_{k}", pa.int64()) for k in BASE_KINDS] + [("base", pa.string()), ("spans", pa.string())])


@F.arrow_udf(_SCHEMA)
def _find(texts: pa.Array) -> pa.Array:
    out = []
    for x in texts:
        text = x.as_py() or ""
        base = ordered(detect(text), BASE_KINDS)
        more = confirmed(text)
        kinds = [k for k, _, _ in base]
        out.append({f"n_{k}": kinds.count(k) for k in BASE_KINDS} | {"base": written(base), "spans": written(ordered([*base, *more], KINDS))})
    return pa.array(out, _ARROW)


def secrets(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex (base spans), base and spans (kind:start:end joined by
    commas, by start and then kind; code points, end exclusive; spans has the confirmed ones too).

    A null text counts as empty; empty texts have no spans. Repeated rows are scored each, very long
    texts whole, an empty table gives no rows. Columns of docs with the names of the new ones are
    replaced."""
    return with_fields(docs, [f"n_{k}" for k in BASE_KINDS] + ["base", "spans"], _find(F.col("text").cast("string")))


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([None if x.as_py() is None else redacted(x.as_py()) for x in texts], pa.string())


def redacted(text: str) -> str:
    """The text with each stretch of secrets replaced by the mark of the kind that begins it."""
    out, at, end = [], 0, 0
    for kind, a, b in ordered([*detect(text), *confirmed(text)], KINDS):
        if a >= end:
            out += [text[at:a] if at <= a else "", f"<{kind.upper()}>"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets (base and confirmed spans) replaced in text; null texts stay null, empty ones
    empty. Other columns stay as they are, repeated rows are redacted each, very long texts whole; an
    empty table gives no rows."""
    return docs.withColumn("text", _redact(F.col("text").cast("string")))

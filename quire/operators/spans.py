"""Inline spans of one text: code, links, images and footnote references, found in one pass, and the
fragments that a line may be broken between.

Tokens are read by one pattern per kind. Which of them stay together is told by a pattern as well: each token
is a letter for what it can be, and a fragment is a stretch of letters."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import explode_lines

# Unicode white space, marks that open and marks that close, months.
WHITE = "\t\n\v\f\r \x85\xa0                　"
OPENING = "([\"“‘（［【《「『"
CLOSING = ".,;:!?)]\"'…—–»›）］】》」』、。，：；！？”’"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

_RUN = re.compile("`+")
_SUFFIX = regex.compile(r"-(?=\p{Alphabetic})[\p{Alphabetic}-]+|'\p{Alphabetic}+|\p{Alphabetic}+")
_MARK = re.compile(r"\\.|[\[\]()]", re.S)


def width_of(text: str) -> int:
    """Terminal columns."""
    # below the first combining mark only the soft hyphen has no width, and nothing has two
    if text.isascii() or max(text) < "\u0300" and "\xad" not in text:
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def escaped(text: str, at: int) -> bool:
    """Whether an odd number of backslashes stands right before a place."""
    n = at
    while n and text[n - 1] == "\\":
        n -= 1
    return (at - n) % 2 == 1


def code_end(text: str, start: int, size: int) -> int | None:
    """Where the code span ends that a run of size backticks before start opens. The first unescaped run of
    that size closes it; but if an escaped one comes before it and another after it, the last escaped one does,
    and also if there is no unescaped one."""
    behind = None
    runs = (m for m in _RUN.finditer(text, start) if m.end() - m.start() == size)
    for m in runs:
        if escaped(text, m.start()):
            behind = m.end()
        elif behind is not None and next(runs, None):
            return behind
        else:
            return m.end()
    return behind


def open_code(text: str) -> tuple[int, int] | None:
    """(size, end) of the first unescaped run of backticks that nothing closes."""
    at = 0
    while m := _RUN.search(text, at):
        if escaped(text, m.start()):
            # one escaped backtick; the rest of the run, if any, opens
            if m.end() - m.start() == 1:
                at = m.end()
                continue
            m = _RUN.match(text, m.start() + 1)
        end = code_end(text, m.end(), m.end() - m.start())
        if end is None:
            return m.end() - m.start(), m.end()
        at = end
    return None


def code_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, size of the backtick runs) of a text's code spans."""
    out, at = [], 0
    while m := _RUN.search(text, at):
        start = m.start()
        if escaped(text, start):
            at = start + 1
            continue
        size = m.end() - start
        end = code_end(text, m.end(), size)
        if end is None:
            at = m.end()
            continue
        out.append((start, end, size))
        at = end
    return out


def suffix_end(text: str, end: int) -> int:
    """The end of a word part right behind a code span: letters, an apostrophe or a hyphen with letters."""
    m = _SUFFIX.match(text, end)
    return m.end() if m else end


class Brackets:
    """Where the brackets and parentheses of a text are closed, escaped ones apart: found in one pass."""

    def __init__(self, text: str):
        self.text, self.ends, self.pairs, self.opened = text, [], {}, []
        stacks: dict[str, list[int]] = {"[": [], "(": []}
        for m in _MARK.finditer(text):
            c = m[0]
            if c in "[(":
                stacks[c].append(m.start())
                if c == "[":
                    self.opened.append(m.start())
            elif len(c) == 1:
                if c == "]":
                    self.ends.append(m.end())
                if opened := stacks["[" if c == "]" else "("]:
                    self.pairs[opened.pop()] = m.end()

    def label_end(self, start: int) -> int | None:
        """The end of the label whose bracket is at start: the next closing bracket."""
        i = bisect_right(self.ends, start)
        return self.ends[i] if i < len(self.ends) else None

    def link_end(self, start: int) -> int | None:
        """The end of the link or image whose bracket (or exclamation mark) is at start: a label, then a target in
        parentheses, nested to any depth, or a second label. A target that nothing closes takes the rest. A label
        with brackets in it counts where a target follows."""
        text = self.text
        start += text[start] == "!"
        end = self.label_end(start)
        if end is None:
            return None
        if text[end : end + 1] == "(":
            return self.pairs.get(end, len(text))
        if text[end : end + 1] == "[" and (second := self.label_end(end)):
            return second
        end = self.pairs.get(start)
        return self.pairs.get(end) if end and text[end : end + 1] == "(" else None

    def targets(self) -> list[tuple[int, int]]:
        """(start, end) of all labels with a closed target behind them."""
        ends = ((start, self.label_end(start)) for start in self.opened)
        return [(start, self.pairs[end]) for start, end in ends if end and self.text[end : end + 1] == "(" and end in self.pairs]

    def note_end(self, start: int) -> int | None:
        """The end of the footnote reference at start."""
        end = self.label_end(start) if self.text.startswith("[^", start) else None
        return None if end is None or self.text[end : end + 1] == "(" else end


# What an autolink's scheme and an address are, and how bare addresses and paths begin.
_ANGLES = re.compile(r"<([^<>]*)>")
_URI = regex.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\p{White_Space}\p{Cc}<>]+\Z")
_ADDRESS = regex.compile(r"[^@\p{White_Space}\p{Cc}<>]+@(?=[^@]*\.)[^@\p{White_Space}\p{Cc}<>]+\Z")
_PATHLIKE = re.compile(r"www\.|/|\./|\.\./|~/|[A-Za-z]:[/\\]")
_CHUNK = regex.compile(r"[^\p{White_Space}]+")


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Stretches of a line that stand for themselves: code, and in the text between backticks links and images,
    autolinks, and chunks with three dots that are addresses or paths. They come by kind and may overlap."""
    out, at, bounds = [], 0, []
    for start, end, _ in code_spans(text):
        out.append((start, suffix_end(text, end)))
    for start, end in [*out, (len(text), len(text))]:
        # backticks that close nothing end a piece of text as well
        for m in _RUN.finditer(text, at, start):
            a = m.start() + escaped(text, m.start())
            if a < m.end():
                bounds.append((at, a))
                at = m.end()
        bounds.append((at, start))
        at = end
    for a, b in bounds:
        piece = text[a:b]
        brackets = Brackets(piece)
        for label, end in brackets.targets():
            image = label > 0 and piece[label - 1] == "!"
            if not (image and escaped(piece, label - 1)):
                out.append((a + label - image, a + end))
        for m in _ANGLES.finditer(piece):
            if not escaped(piece, m.start()) and (_URI.match(m[1]) or _ADDRESS.match(m[1])):
                out.append((a + m.start(), a + m.end()))
        for m in _CHUNK.finditer(piece):
            bare = m[0].lstrip("([{\"'")
            if "..." in bare and (_PATHLIKE.match(bare) or _URI.match(bare)):
                out.append((a + m.start(), a + m.end()))
    return out


# A word ends at white space, a backtick, a bracket, an image, and before the parenthesis of a citation; escaped
# marks are part of it, and the bracket behind an escaped exclamation mark or parenthesis.
_WORD = regex.compile(
    r"(?:\\(?:[!(]\[?|[^`\p{White_Space}]|)|[^\\`\[(!\p{White_Space}]|\((?!\[)|!(?!\[))++|\(", regex.S
)
_BLANK = regex.compile(r"\p{White_Space}+")
_AFTER_LINK = re.compile(r"(?:(?!\(\[)[.,;:!?()\]\"'])+")


def tokens(text: str) -> list[str]:
    """White space, code spans, links and images, footnote references, the punctuation behind them, and
    pieces of words, in order; together they are the text."""
    out, at, n, brackets = [], 0, len(text), None
    while at < n:
        c = text[at]
        if blank := _BLANK.match(text, at):
            end = blank.end()
        elif c == "`":
            if escaped(text, at):
                if out:
                    out[-1] += c
                else:
                    out.append(c)
                at += 1
                continue
            run = _RUN.match(text, at).end()
            end = code_end(text, run, run - at)
            if end is None:
                end = run
            elif end > at + 2 * (run - at):
                end = suffix_end(text, end)
        elif (c == "[" or text.startswith("![", at)) and not escaped(text, at):
            brackets = brackets or Brackets(text)
            end = brackets.note_end(at) or brackets.link_end(at) or at + 1
            out.append(text[at:end])
            if after := _AFTER_LINK.match(text, end):
                out.append(after[0])
                end = after.end()
            at = end
            continue
        else:
            end = _WORD.match(text, at).end()
        out.append(text[at:end])
        at = end
    return out


_O, _C = re.escape(OPENING), re.escape(CLOSING)
_CODE_LIKE = re.compile(rf"[{_O}]*(?:(`++)(?=.*?\1)|``+[{_C}]*\Z)", re.S)
_LINK_LIKE = re.compile(r"!?\[.*\]\(.*\)\Z", re.S)
_LINK_WITHIN = re.compile(rf"[{_O.replace(chr(92) + '[', '')}]*!?\[.*\]\(.*\)[{_C}]*\Z", re.S)
_NOTE_LIKE = re.compile(r"\[\^.+\]\Z", re.S)
_NOTE_LAST = re.compile(r"\[\^(?:(?!\[\^).)+\]\Z", re.S)
_CLOSERS, _OPENERS = re.compile(rf"[{_C}]+\Z"), re.compile(rf"[{_O}]+\Z")
_HYPHEN = regex.compile(r".*\p{Alphabetic}.*-\Z", regex.S)


def _letter(token: str) -> str:
    """s white space; b one backtick; x a link around code, c code, i code that backticks end; l link; f footnote
    reference; ':'; q quotation mark, p other closing marks; o opening marks; h word with a hyphen at its end; W word
    with a closing mark at its end, w other word."""
    if token[0] in WHITE:
        return "s"
    if "`" in token:
        if token == "`":
            return "b"
        if token[0] == "`" == token[-1]:
            return "i"
        if _CODE_LIKE.match(token):
            return "x" if _LINK_LIKE.match(token) else "c"
    if token[0] in "[!":
        if _LINK_LIKE.match(token):
            return "l"
        if _NOTE_LIKE.match(token):
            return "f"
    last = token[-1]
    if last == ":" and len(token) == 1:
        return ":"
    if last in CLOSING and _CLOSERS.match(token):
        return "q" if _OPENERS.match(token) else "p"
    if last in OPENING and _OPENERS.match(token):
        return "o"
    if last == "-" and _HYPHEN.match(token):
        return "h"
    return "W" if last in CLOSING else "w"


_DAY = rf"[{_O}]*\+?0*(?:[1-9]|[12][0-9]|3[01])"
_MONTH = rf"(?i:[{_O}]*(?:{MONTHS}))"
_NUMBER, _ORDINAL = re.compile(_DAY + r",?\Z"), re.compile(_DAY + r"(?:st|nd|rd|th),?\Z")
_NAME, _YEAR = re.compile(_MONTH + r",?\Z"), re.compile(rf"\+?0*[12][0-9]{{3}}[{_C}]*\Z")


def _with_dates(letters: str, parts: list[str]) -> str:
    """The letters with d==== for a date's five tokens, D==== if its year ends in a closing mark."""
    at = 0
    while at + 4 < len(parts):
        first, second, year = parts[at], parts[at + 2], parts[at + 4]
        if letters[at + 1] == letters[at + 3] == "s" and year[-1:] and _YEAR.match(year):
            day_first = (_NUMBER.match(first) or _ORDINAL.match(first)) and _NAME.match(second)
            if day_first or (_NAME.match(first) and (_NUMBER.match(second) or _ORDINAL.match(second))):
                letters = letters[:at] + ("D" if year[-1] in CLOSING else "d") + "====" + letters[at + 5 :]
                at += 5
                continue
        at += 1
    return letters


_P = "[:pq]"
_AFTER_LINKS = rf"(?:{_P}|s(?=[lxi:pq])|o[lx]|f|[lx])*+"
_AFTER_CODE = rf"(?:{_P}|s(?={_P})|f|[icx])*+(?:o[lx]{_AFTER_LINKS})?+"
_AFTER_NOTE = rf"(?:{_P})*+(?:o[lx]{_AFTER_LINKS})?+"
#: What stays on one line: code or a link with what is attached to it, a date, a word with its reference.
_TOGETHER = re.compile(
    rf"D====(?:f{_P}*+)?+|d====|b[^b]*+(?:b{_P}*+)?+{_AFTER_CODE}|[oqh]?[icx]{_AFTER_CODE}|[oq]?l{_AFTER_LINKS}|f{_AFTER_NOTE}"
    rf"|(?:(?:[swWhopq:]s|s)(?=f:)f{_AFTER_NOTE}|[swWhopq:]o[lx]{_AFTER_LINKS}|[Wpq:]f{_AFTER_NOTE}|[swWhopq:=])"
)


class Fragment(NamedTuple):
    kind: str  # whitespace, code, link, footnote or plain
    text: str
    width: int


def kind_of(text: str) -> str:
    """The kind of a fragment: what it holds besides marks around it."""
    if text[0] in WHITE and not text.strip(WHITE):
        return "whitespace"
    if "](" in text and _LINK_WITHIN.match(text):
        return "link"
    if "`" in text and _CODE_LIKE.match(text):
        return "code"
    return "footnote" if text[-1] == "]" and _NOTE_LAST.search(text) else "plain"


_SPACED_MARK = regex.compile(r"(?<=`)\p{White_Space}+(?=\Z)")


#: A text without any of these has neither spans nor dates.
_MORE = re.compile(r"[`\[]|[12][0-9]{3}")
_ASCII_WORDS = re.compile(r"[\t-\r ]+|[^\t-\r ]+")
_WORDS = regex.compile(r"\p{White_Space}+|[^\p{White_Space}]+")


def fragments(text: str) -> list[Fragment]:
    """The pieces of a text that lines are made of, in order. White space between closing punctuation and a footnote
    reference goes, and that between code and one mark of punctuation."""
    if not _MORE.search(text):
        # nothing but words
        if text.isascii():
            return [Fragment("whitespace" if x[0] in WHITE else "plain", x, len(x)) for x in _ASCII_WORDS.findall(text)]
        return [Fragment("whitespace" if x[0] in WHITE else "plain", x, width_of(x)) for x in _WORDS.findall(text)]
    parts = tokens(text)
    letters = "".join(map(_letter, parts))
    if "f" in letters:
        gone = {m.start() + 1 for m in re.finditer(r"[Wpq:]sf|[xl]sf", letters) if parts[m.start()][-1] in CLOSING}
        if gone:
            parts = [p for i, p in enumerate(parts) if i not in gone]
            letters = "".join(c for i, c in enumerate(letters) if i not in gone)
    if regex.search(r"[0-9]", text):
        letters = _with_dates(letters, parts)
    out = []
    for m in _TOGETHER.finditer(letters):
        if m.end() - m.start() == 1:
            made = parts[m.start()]
        else:
            made = ""
            for part in parts[m.start() : m.end()]:
                if len(part) == 1 and part in ".?!,:;":
                    made = _SPACED_MARK.sub("", made)
                made += part
        out.append(Fragment(kind_of(made), made, width_of(made)))
    return out


_FRAGMENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("width", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("width", pa.int64())]))


@F.arrow_udf(_FRAGMENTS)
def _fragments(column: pa.Array) -> pa.Array:
    return pa.array([[f._asdict() for f in fragments(x)] if x else [] for x in column.to_pylist()], _ARROW)


def inline_fragments(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, kind, text, width): the fragments of every line outside fenced code. Null and empty
    lines have none."""
    rows = explode_lines(docs).where(~F.col("code") & F.col("line").isNotNull())
    found = rows.select("doc_id", "line_no", F.posexplode(_fragments("line")).alias("pos", "f"))
    return found.select("doc_id", "line_no", F.col("pos").cast("long"), "f.*")

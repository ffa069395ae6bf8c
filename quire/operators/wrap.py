"""Wrapping: stretches of lines that belong together are found, and each is fitted to a width.

Spark tells what each line is. Blocks are stretches between lines that wrapping leaves alone. Within one, lines are joined into
paragraphs and items, whose fragments are fitted first and mended then: white space alone on a line joins a
neighbour, and the last piece of a line moves down if a word follows and it fits there. So a word may end in the
last column before code, but not before another word.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.arrays import let
from .lines import code_lines, dealt, known_lines, link_parts
from .spans import WHITE, Fragment, code_end, code_spans, escaped, fragments, open_code, width_of

Line = list[Fragment]
_SPACE = " "
_BACKTICKS = re.compile("`+")


def _total(line: Line) -> int:
    return sum(f.width for f in line)


def _blank(line: Line) -> bool:
    return all(f.kind == "whitespace" for f in line)


def _first_fit(pieces: Line, width: int) -> list[Line]:
    lines: list[Line] = [[]]
    used = 0
    for f in pieces:
        if lines[-1] and used + f.width > width:
            lines.append([])
            used = 0
        lines[-1].append(f)
        used += f.width
    return lines


def _without_blank_lines(lines: list[Line], width: int) -> list[Line]:
    """Lines of white space alone go, or go with the line behind them. Code before one moves down with it,
    unless code or a link follows or it wouldn't fit there."""
    out: list[Line] = []
    carried: Line = []
    for i, line in enumerate(lines):
        if not _blank(line):
            out.append(carried + line)
            carried = []
            continue
        one = len(line) == 1 and line[0].text == _SPACE
        keep = not one or bool(out and len(out[-1]) == 1)
        following = lines[i + 1] if i + 1 < len(lines) else []
        if one and out and out[-1][-1].kind == "code" and not (following and following[0].kind in ("code", "link", "footnote")):
            target = next((x for x in lines[i + 1 :] if not _blank(x)), None)
            if target is None or out[-1][-1].width + 1 + _total(target) <= width:
                carried.append(out[-1].pop())
                if not out[-1]:
                    out.pop()
                keep = True
        if keep:
            carried += line
    if carried:
        if out:
            out[-1] = out[-1] + carried
        else:
            out.append(carried)
    return out


def _with_tails_moved(lines: list[Line], width: int) -> list[Line]:
    """Where a line begins with a space and a word, the last piece of the line before joins it, if it fits."""
    for above, below in zip(lines, lines[1:]):
        if len(below) > 1 and below[0].text == _SPACE and below[1].kind == "plain" and len(above) > 1 and above[-1].kind != "whitespace":
            if _total(below) + above[-1].width <= width:
                below.insert(0, above.pop())
    return lines


def fit_fragments(pieces: list[Fragment], width: int) -> list[str]:
    """Lines of at most width columns; a wider fragment has a line of its own. The last line keeps white space at
    its end, others lose a single space."""
    out: list[str] = []
    buffer: Line = []
    held = shown = 0

    def write(line: Line, last: bool = False) -> None:
        nonlocal shown
        text = "".join(f.text for f in line)
        if not last and text.endswith(" ") and not text.endswith("  "):
            text = text[:-1]
        out.append(text.lstrip(WHITE) if out else text)
        shown = width_of(out[-1])

    for piece in pieces:
        if len(buffer) == 1 and buffer[0].kind == "link" and out and width - 1 <= shown <= width and piece.kind in ("whitespace", "plain"):
            # a link behind a full line stands alone
            write(buffer)
            buffer, held = [], 0
            if piece.kind == "whitespace":
                continue
        buffer.append(piece)
        held += piece.width
        if held <= width:
            continue
        lines = _with_tails_moved(_without_blank_lines(_first_fit(buffer, width), width), width)
        if len(lines) == 1:
            continue
        for line in lines[:-1]:
            write(line)
        above, buffer = lines[-2], lines[-1]
        if len(buffer) > 1 and buffer[0].kind == "link" and buffer[1].kind in ("whitespace", "plain") and width - 1 <= _total(above) <= width:
            write(buffer[:1])
            buffer = buffer[1:]
        held = _total(buffer)
    if buffer:
        write(buffer, True)
    return out


def _kept_ends(text: str, lines: list[str], ends: list[int], width: int) -> list[str]:
    """lines, fitted from text, with code spans that are wider than a line cut where the text's line ends (places
    of spaces) are."""
    for start, end, _ in code_spans(text):
        cuts = ends[bisect_right(ends, start) : bisect_left(ends, end)]
        if not cuts or width_of(text[start:end]) <= width:
            continue
        span = text[start:end]
        at = next((i for i, line in enumerate(lines) if span in line), None)
        if at is None:
            continue
        before, _, behind = lines[at].partition(span)
        made = [text[a:b] for a, b in zip([start, *(c + 1 for c in cuts)], [*cuts, end])]
        if before:
            if width_of(before + made[0]) <= width:
                made[0] = before + made[0]
            else:
                made = fit(before.rstrip(WHITE), width) + made
        if behind:
            if width_of(made[-1] + behind) <= width:
                made[-1] += behind
            else:
                made += fit(behind.lstrip(WHITE), width)
        lines = lines[:at] + made + lines[at + 1 :]
    return lines


def fit(text: str, width: int, ends: list[int] | None = None) -> list[str]:
    """A text in lines of at most width columns. ends are the places of spaces that were line ends: if all lines
    between them were narrow enough, a code span that is too wide keeps its own."""
    lines = fit_fragments(fragments(text), width)
    if ends and all(width_of(text[a:b].strip(" ")) <= width for a, b in zip([0, *ends], [*ends, len(text)])):
        lines = _kept_ends(text, lines, ends, width)
    return lines


def joined(parts: list[str], trim: bool = False) -> tuple[str, list[int]]:
    """Lines of one paragraph as a text, and where its line ends were. With trim, a line end right
    inside the backticks of a code span leaves no space."""
    text, ends, at = " ".join(parts), [], 0
    for part in parts[:-1]:
        at += len(part) + 1
        ends.append(at - 1)
    return (trimmed_spans(text, ends), []) if trim else (text, ends)


def trimmed_spans(text: str, ends: list[int]) -> str:
    """The text without those of its spaces at ends that are the first or last character within a code span. A run of
    backticks closes the span of an equal one; a span that nothing closes ends the search."""
    known, gone, opened = set(ends), set(), None
    for m in _BACKTICKS.finditer(text) if known else ():
        a = m.start() + escaped(text, m.start())
        if a == m.end():
            continue
        if opened is None:
            opened = (a, m.end())
        elif m.end() - a == opened[1] - opened[0] and text[a - 1] != "`":
            gone |= {x for x in (opened[1], a - 1) if opened[1] < a and x in known}
            opened = None
    return "".join(c for i, c in enumerate(text) if i not in gone) if gone else text


# Lines of a block


_TAGS = regex.compile(r"(?:(?i:<br\p{White_Space}*/?>)\p{White_Space}*)+\Z")


def _content(line: str) -> tuple[str, bool]:
    """A line's text and whether a hard break ends it: two spaces, a br tag or an odd number of backslashes."""
    bare = line.rstrip(WHITE)
    text = _TAGS.sub("", bare) if bare.endswith(">") else bare
    hard = line.endswith("  ") or text != bare or escaped(bare, len(bare))
    return text.lstrip(WHITE).rstrip(" "), hard


def _marked(line: str) -> int:
    """Length of the hard break mark at a line's end."""
    return 2 if line.endswith("  ") else int(escaped(line, len(line)))


def _with_break(lines: list[str]) -> None:
    if lines and not _marked(lines[-1]):
        lines[-1] += "  "


def _state_after(text: str, size: int) -> int:
    """Size of the code span that is open behind a text, 0 for none, if one of size was open before it."""
    for m in _BACKTICKS.finditer(text):
        a, n = m.start(), m.end() - m.start()
        if size:
            if n == size:
                size = 0
        elif not escaped(text, a):
            size = n
        elif n > 1:
            size = n - 1
    return size


_WORDLY = regex.compile(r"[\p{Alphabetic}\p{N}_]")


class Item:
    """An item, quote or definition with a code span that its line leaves open; lines that follow are joined until
    the span is closed. Its rest is then fitted, or its lines stay as they were (verbatim)."""

    def __init__(self, prefix: str, rest: str, repeats: bool, outer: str | None, width: int):
        size, end = open_code(rest)
        self.prefix, self.rest, self.repeats, self.outer = prefix, rest, repeats, outer
        self.room = max(1, width - width_of(prefix))
        self.mode = "fit" if rest[end:].strip(WHITE) else "tight"
        if self.mode == "tight":
            self.rest = rest[:end]
        self.open, self.hard, self.begun, self.split = size, False, False, False
        self.sources, self.spaces = [prefix + rest], []

    @property
    def behind(self) -> str:
        """The prefix of lines after the first."""
        if self.repeats:
            return self.prefix
        outer = self.outer if self.outer is not None else self.prefix[: len(self.prefix) - len(self.prefix.lstrip(WHITE))]
        return outer + " " * max(0, width_of(self.prefix) - width_of(outer))

    def next_prefix(self) -> str:
        prefix, self.begun = (self.behind if self.begun else self.prefix), True
        return prefix

    def lines(self) -> list[str]:
        """What is held, as lines; a tail behind the first line is fitted again without it, so that fitting the result
        once more changes nothing."""
        if self.mode == "verbatim":
            return self.sources
        prefix = self.next_prefix()
        first, *more = fit(trimmed_spans(self.rest, self.spaces), self.room) or [""]
        out = [prefix + first]
        if self.repeats:
            out += [prefix + x for x in more]
        else:
            behind, tail = self.behind, ""
            for i, line in enumerate(more):
                n = _marked(line)
                tail += (" " if tail else "") + line[: len(line) - n]
                if n or i + 1 == len(more):
                    out += [behind + x for x in fit(tail, self.room)]
                    out[-1] += line[len(line) - n :]
                    tail = ""
        if self.hard:
            _with_break(out)
        return out


class Block:
    """Reads the lines of a block and writes them wrapped."""

    def __init__(self, width: int):
        self.width = width
        self.out: list[str] = []
        self.held: list[tuple[str, bool]] = []
        self.indent, self.next_indent = "", None
        self.item: Item | None = None

    def flush(self) -> None:
        if self.item:
            item, self.item = self.item, None
            self.held, self.indent = [], ""
            self.out += item.lines()
            if not item.repeats:
                self.next_indent = item.behind
            return
        if self.held:
            room = max(1, self.width - width_of(self.indent))
            at = 0
            while at < len(self.held):
                end = next((i + 1 for i in range(at, len(self.held)) if self.held[i][1]), len(self.held))
                made = fit(*self._joined(self.held[at:end], room)) if any(x for x, _ in self.held[at:end]) else []
                lines = [self.indent + x for x in made]
                if self.held[end - 1][1]:
                    _with_break(lines or self.out)
                self.out += lines
                at = end
            self.held, self.indent, self.next_indent = [], "", None

    @staticmethod
    def _joined(held: list[tuple[str, bool]], room: int) -> tuple[str, int, list[int]]:
        text, ends = joined([x for x, _ in held])
        return text, room, ends

    def verbatim(self, line: str) -> None:
        self.flush()
        self.next_indent = None
        self.out.append(line if line.strip(WHITE) else "")

    def begin(self, row: dict) -> None:
        """A line with a prefix: an item, quote or definition."""
        self.flush()
        self.next_indent = None
        prefix, rest = row["prefix"], row["rest"]
        if rest.rstrip(WHITE).endswith(">") and (tags := _TAGS.search(rest)):
            rest = rest[: tags.start()].rstrip(WHITE) + "  "
        if open_code(rest):
            self.item = Item(prefix, rest, row["repeats"], row["quote"], self.width)
            return
        room = max(1, self.width - width_of(prefix))
        first, *more = fit(rest, room) or [""]
        behind = prefix
        if not row["repeats"]:
            outer = row["quote"] if row["quote"] is not None else prefix[: len(prefix) - len(prefix.lstrip(WHITE))]
            behind = outer + " " * max(0, width_of(prefix) - width_of(outer))
        self.out += [prefix + first, *(behind + x for x in more)]

    def go_on(self, text: str, hard: bool, source: str) -> None:
        """Join one more line to the item."""
        item = self.item
        size = item.open
        lead = _BACKTICKS.match(text)
        space = item.mode != "tight" and not (lead and lead.end() == size)
        if space and size and item.rest.endswith("(") and (opened := open_code(item.rest)):
            depth = 0
            for c in item.rest[opened[1] :]:
                depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
            space = depth <= 1
        gap = " " if item.rest and space else ""
        end = code_end(text, 0, size) if text and size else None
        closes = end is not None and not text[end:].strip(WHITE) and not _state_after(text, size)
        item.sources.append(source)
        if closes and width_of(item.rest + gap + text) > item.room:
            # joined, the span would not fit: its lines stay
            if item.mode == "verbatim":
                self.flush()
                return
            self.item = None
            for line, breaks in ((item.next_prefix() + item.rest, item.hard), (source, hard)):
                self.out.append(line + ("  " if breaks and not line.endswith("  ") else ""))
            return
        item.hard |= hard
        if not text:
            return
        if gap:
            item.spaces.append(len(item.rest))
        offset = len(item.rest) + len(gap)
        item.rest += gap + text
        after = _state_after(text, size) if size else 0
        again = self._opened_again(text, size)
        if after:
            if again:
                item.mode = "verbatim"
            item.open = after
            item.split |= item.mode == "verbatim"
        elif again:
            item.open, item.split = 0, True
            self._divide(offset + again[0], again[1])
        else:
            item.open = 0
            word = size and end is not None and _WORDLY.match(text, end)
            item.mode = "verbatim" if word else "fit"
            if hard or item.split:
                self.flush()

    @staticmethod
    def _opened_again(text: str, size: int) -> tuple[int, int] | None:
        """(place, size) of a span that a line opens behind the one it closes, if it goes on there."""
        end = code_end(text, 0, size) if size else 0
        if end is None or not (found := open_code(text[end:])) or found[1] == len(text) - end:
            return None
        return end + found[1] - found[0], found[0]

    def _divide(self, at: int, size: int) -> None:
        """Write what is before the reopened span; the rest goes on as the item."""
        item = self.item
        if item.rest[:at]:
            prefix = item.next_prefix()
            first, *more = fit(item.rest[:at], item.room) or [""]
            lines = [prefix + first, *((prefix if item.repeats else item.behind) + x for x in more)]
            if item.hard:
                _with_break(lines)
            self.out += lines
        tail = item.rest[at + size :]
        blank = not tail.strip(WHITE)
        item.rest = "`" * size + ("" if blank else tail)
        item.spaces = [x - at for x in item.spaces if 0 <= x - at < len(item.rest)]
        found = open_code(item.rest)
        item.open, item.mode, item.hard = found[0] if found else 0, "tight" if blank else "fit", False
        item.sources = [item.behind + item.rest]
        if not found:
            self.flush()

    def _continues(self, row: dict) -> bool:
        """Whether a line was taken by the open item (or began one in its place)."""
        item, quote = self.item, row["quote"]
        if quote is not None and item.outer == quote and row["kind"] is None:
            self.go_on(*_content(row["inner"]), row["line"])
        elif row["prefix"] is not None:
            if row["repeats"] and item.prefix == row["prefix"]:
                self.go_on(*_content(row["rest"]), row["line"])
            else:
                self.begin(row)
        elif row["as_is"]:
            self.verbatim(row["line"])
        elif item.open:
            self.go_on(*_content(row["inner"]), row["line"])
        elif row["line"].startswith(item.behind):
            self.go_on(*_content(row["line"][len(item.behind) :]), row["line"])
        else:
            self.flush()
            return False
        return True

    def read(self, row: dict) -> None:
        if self.item and self._continues(row):
            return
        if row["as_is"]:
            self.verbatim(row["line"])
        elif row["prefix"] is not None:
            self.begin(row)
        else:
            if not self.held:
                inner = row["inner"]
                own = inner[: len(inner) - len(inner.lstrip(WHITE))]
                self.indent = (self.next_indent if self.next_indent is not None else own) if own else ""
                self.next_indent = None
            self.held.append(_content(row["inner"]))


def wrapped(rows: list[dict], width: int) -> list[str]:
    """The lines of a block, wrapped."""
    block = Block(width)
    for row in rows:
        block.read(row)
    block.flush()
    return block.out


def wrapped_document(rows: list[dict], width: int) -> list[str]:
    """The lines of a document, each block wrapped: a stretch of lines between those that stay alone."""
    out: list[str] = []
    for alone, block in groupby(rows, lambda row: row["alone"]):
        out += [row["line"] for row in block] if alone else wrapped(list(block), width)
    return out


def _wrapper(width: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(documents: pa.Array) -> pa.Array:
        return pa.array([wrapped_document(x, width) if x else [] for x in documents.to_pylist()], pa.list_(pa.string()))

    return run


def is_verbatim(line: Column, kind: Column | None = None) -> Column:
    """Lines that wrapping leaves alone: tables, separators, headings, directives, link definitions,
    blank and indented lines. kind is the line's block kind, if it is known."""
    kind = X.block_kind(line) if kind is None else kind
    return (
        (line.contains("|") & X.ltrim(line).startswith("|")) | line.rlike(X.SEPARATOR) | X.is_blank(line) | (X.indent_columns(line) >= 4)
        | F.coalesce(kind.isin("heading", "markdownlint_directive", "link_reference_definition"), F.lit(False))
    )


def _row(line: Column, stays: Column, code: Column) -> Column:
    """What Block.read() wants to know of a line; only the line itself if it is alone: no open item can take it, so it ends
    a block."""

    def of(quote: Column) -> Column:
        inner = F.when(quote.isNotNull(), F.regexp_extract(line, X.QUOTE, 2)).otherwise(line)
        return let(inner, lambda inner: with_marks(quote, inner))

    def with_marks(quote: Column, inner: Column) -> Column:
        own = F.when(inner.rlike(X.BULLET), F.regexp_extract(inner, X.BULLET, 1)).when(
            inner.contains("[^") & inner.rlike(X.FOOTNOTE_DEFINITION), F.concat(F.regexp_extract(inner, X.FOOTNOTE_DEFINITION, 1), F.regexp_extract(inner, X.FOOTNOTE_DEFINITION, 2))
        )
        return let(F.struct(own.alias("own"), X.block_kind(inner).alias("kind")), lambda x: made(quote, inner, x["own"], x["kind"]))

    def made(quote: Column, inner: Column, own: Column, kind: Column) -> Column:
        has_prefix = own.isNotNull() | quote.isNotNull()

        def row(as_is: Column) -> Column:
            alone = stays | (as_is & ~has_prefix)
            # the prefix is cut by length: what follows it may hold anything
            prefix = F.when(has_prefix, F.concat(F.coalesce(quote, F.lit("")), F.coalesce(own, F.lit(""))))
            values = {"quote": quote, "inner": inner, "kind": kind, "as_is": as_is, "prefix": prefix, "repeats": own.isNull(), "rest": F.substr(inner, F.coalesce(F.length(own), F.lit(0)) + 1)}
            shown = F.when(alone & X.is_blank(line) & ~code, "").otherwise(line)
            return F.struct(shown.alias("line"), alone.alias("alone"), *[F.when(~alone, x).alias(name) for name, x in values.items()])

        return let(stays | is_verbatim(inner, kind), row)

    return let(F.when(line.contains(">") & line.rlike(X.QUOTE), F.regexp_extract(line, X.QUOTE, 1)), of)


def changes(lines: Column, width: int) -> Column:
    """Whether wrapping may change a document: a line is wide, may join the one before, has white space at its end, or
    something between whose parts white space may go."""
    own = F.exists(lines, lambda x: (F.length(x) > width // 2) & (X.display_width(x) > width) | x.rlike(r"[`\[]|(?:\p{IsWhite_Space}|\\\\|>)\z"))
    blank = F.transform(lines, X.is_blank)
    # no two lines that follow each other hold text
    pairs = F.exists(F.arrays_zip(blank.alias("a"), F.slice(blank, 2, F.greatest(F.size(blank), F.lit(1))).alias("b")), lambda p: ~p["a"] & ~F.coalesce(p["b"], F.lit(True)))
    return own | pairs


def wrap(docs: DataFrame, width: int = X.WRAP_COLUMNS, tasks: int | None = None) -> DataFrame:
    """Documents with paragraphs, list items, footnote definitions and quotes wrapped to width.

    Plain lines join into one paragraph under the first one's indent; a hard break (two spaces, a br
    tag or an odd backslash) ends one with two spaces. An item, definition or quote line is a paragraph
    of its own, with the lines that end a code span it leaves open: its prefix is repeated for quotes,
    otherwise its continuation lines are indented. A code span that is wider than a line keeps its own line
    ends in a plain paragraph whose lines were all narrow enough, and in an item whose span its next line ends."""
    lines = F.col("lines")
    docs = dealt(docs, tasks).select("doc_id", known_lines(lines).alias("lines"))
    docs = docs.withColumn("_code", F.when(changes(lines, width), let(lines, code_lines)))
    docs = docs.withColumn("_parts", F.when(F.col("_code").isNotNull(), link_parts(lines, F.col("_code"))))
    kept = F.zip_with("_code", "_parts", lambda c, p: F.struct(c.alias("code"), (c | p).alias("stays")))
    docs = docs.withColumn("_rows", F.zip_with("lines", kept, lambda x, k: _row(x, k["stays"], k["code"]))).drop("_code", "_parts")
    docs = docs.withColumn("_made", _wrapper(width)("_rows"))
    return docs.select("doc_id", F.when(F.col("_rows").isNotNull(), F.col("_made")).otherwise(lines).alias("lines"))

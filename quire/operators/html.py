"""HTML tables in documents as pipe tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import FenceState, known_lines
from .tables import reflowed

# Patterns of table tags, and elements whose text is no content.
_STARTS = re.compile(r"<table(?:[\s>]|\Z)", re.I)
_OPENS, _ENDS = re.compile(r"<table(?:[\s>]|$)", re.I), re.compile(r"</table>", re.I)
_IGNORED = frozenset("script style noscript template head".split())


_GROUPS = frozenset("tbody thead tfoot".split())
_CELLS = frozenset("td th caption".split())
_PARTS_OF_TABLES = _GROUPS | _CELLS | frozenset("tr colgroup col".split())
_FRAMES = _PARTS_OF_TABLES | frozenset(["table"])
#: Which open elements a part of a table may stand in; the first of them is supplied where it is missing.
_WITHIN = {"tr": ("tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "col": ("colgroup",)} | dict.fromkeys([*_GROUPS, "caption", "colgroup"], ("table",))
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style template".split())


class Element:
    """An element of the tree: its name, and elements and texts in it."""

    def __init__(self, name: str):
        self.name, self.children = name, []

    def below(self) -> Iterator[Element | str]:
        """Elements and texts below, in order; nothing of elements without content."""
        todo = [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
                continue
            yield child
            if isinstance(child, Element) and child.name not in _IGNORED:
                todo.append(iter(child.children))


class TreeBuilder(HTMLParser):
    """The tree of a piece of HTML with its tables repaired, as browsers do: a row without a group and a cell without
    a row get one; a part of a table ends whatever it can't stand in; in a table, what is no part of it moves before
    it; a table that begins there ends it; an end tag that matches nothing within its cell is passed over."""

    def __init__(self) -> None:
        super().__init__()
        self.root = Element("body")
        self.open = [self.root]
        self.text: list[str] = []  # not yet put into the tree

    def _frame(self) -> int:
        """Place of the innermost open table or part of one, 0 for none."""
        return next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].name in _FRAMES), 0)

    def _add(self, node: Element | str) -> None:
        """Into the open element, or before its table if that is no place for it."""
        target = self.open[-1]
        part = isinstance(node, Element) and (node.name in _PARTS_OF_TABLES or node.name in _HIDDEN)
        blank = isinstance(node, str) and not node.strip()
        if target.name in _FRAMES - _CELLS and not part and not blank:
            i = max(i for i, x in enumerate(self.open) if x.name == "table")
            parent, table = self.open[i - 1], self.open[i]
            parent.children.insert(len(parent.children) - 1 if parent.children and parent.children[-1] is table else len(parent.children), node)
        else:
            target.children.append(node)
        if isinstance(node, Element) and node.name not in _EMPTY:
            self.open.append(node)

    def _flush(self) -> None:
        if self.text:
            node, self.text = "".join(self.text), []
            self._add(node)

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_starttag(self, tag: str, attrs) -> None:
        self._flush()
        at = self._frame()
        if any(x.name == "template" for x in self.open):
            self.open[-1].children.append(node := Element(tag))
            if tag not in _EMPTY:
                self.open.append(node)
        elif tag in _PARTS_OF_TABLES:
            if not at:
                return  # no table around it
            wanted = _WITHIN[tag]
            # end what it can't stand in, up to its table
            while self.open[at].name != "table" and self.open[at].name not in wanted:
                del self.open[at:]
                at = self._frame()
            del self.open[at + 1 :]
            if self.open[at].name not in wanted:
                self.handle_starttag(wanted[0], [])
            self._add(Element(tag))
        elif tag == "table" and at and self.open[at].name not in _CELLS:
            del self.open[max(i for i, x in enumerate(self.open) if x.name == "table") :]
            self._add(Element(tag))
        elif tag not in ("html", "head", "body", "form") or tag == "form" and not at:
            self._add(Element(tag))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].name
            if tag == "template" != name:
                continue
            if name == tag:
                del self.open[i:]
                return
            if name == "template":
                return
            # end tags of tables and their parts reach through cells and rows, but not out of their table; others stop there
            if name == "table" or name in _FRAMES and tag not in _FRAMES:
                return
            if tag in ("td", "th", "caption") and name in _PARTS_OF_TABLES:
                return

    def close(self) -> None:
        super().close()
        self._flush()


def _text(cell: Element) -> str:
    return " ".join("".join(x for x in cell.below() if isinstance(x, str)).split())


def tables_of(html: str) -> list[list[list[tuple[bool, str]]]]:
    """Rows of (is header, text) of cells per table, outer tables before inner ones; the rows of an outer table
    include those of inner ones, and so do texts of cells."""
    parser = TreeBuilder()
    parser.feed(html)
    parser.close()
    found = [x for x in parser.root.below() if isinstance(x, Element) and x.name == "table"]
    out = []
    for table in found:
        rows = [x for x in table.below() if isinstance(x, Element) and x.name == "tr"]
        cells = ([c for c in row.children if isinstance(c, Element) and c.name in ("td", "th")] for row in rows)
        head = lambda c: c.name == "th" or any(isinstance(x, Element) and x.name in ("b", "strong") for x in c.below())
        out.append([[(head(c), _text(c)) for c in row] for row in cells])
    return out


def pipe_rows(block: list[str]) -> list[list[str]]:
    """Pipe tables of the tables of a block of HTML lines, before reflow."""
    indent, out = re.match(r"\s*", block[0])[0], []
    for rows in tables_of("\n".join(block)):
        if not rows:
            continue
        lines = ["| " + " | ".join(" ".join(text.split()) for _, text in row) + " |" for row in rows]
        if all(head for head, _ in rows[0]) or len(rows) > 1:
            lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
        out.append([indent + x for x in lines])
    return out


def parts_of(lines: list[str], fences: bool = True) -> list[tuple[bool, list[str]]]:
    """A document as stretches of lines, (True, pipe rows) where an HTML table stood. A table left open,
    or cut by a fence, stays as it is; without fences, fenced code is converted like any text."""
    out: list[tuple[bool, list[str]]] = []
    state, block, depth = FenceState(), [], 0
    for line in lines:
        _, marker, inside, _ = state.read(line)
        if fences and (marker or inside):
            if not out or out[-1][0]:
                out.append((False, []))
            out[-1][1].extend([*block, line])
            block, depth = [], 0
        elif block or _STARTS.match(line.lstrip()):
            block.append(line)
            depth = max(0, depth + len(_OPENS.findall(line)) - len(_ENDS.findall(line)))
            if not depth:
                tables = pipe_rows(block) if any(_OPENS.search(x) for x in block) else None
                out += [(True, t) for t in tables] if tables is not None else [(False, block)]
                block = []
        elif out and not out[-1][0]:
            out[-1][1].append(line)
        else:
            out.append((False, [line]))
    return [*out, (False, block)] if block else out


_PARTS = T.ArrayType(T.StructType([T.StructField("table", T.BooleanType()), T.StructField("block", T.ArrayType(T.StringType()))]))
_PARTS_ARROW = pa.list_(pa.struct([("table", pa.bool_()), ("block", pa.list_(pa.string()))]))


def _parts(fences: bool):
    @F.arrow_udf(_PARTS)
    def parts(column: pa.Array) -> pa.Array:
        return pa.array([[{"table": t, "block": b} for t, b in parts_of(lines or [], fences)] for lines in column.to_pylist()], _PARTS_ARROW)

    return parts


def convert_html_tables(docs: DataFrame, fences: bool = True) -> DataFrame:
    """Documents with HTML tables outside fenced code as reflowed pipe tables. Only documents that hold
    a table tag are parsed; the others travel whole. Without fences, tables in fenced code are converted too."""
    docs = docs.select("doc_id", known_lines(F.col("lines")).alias("lines"))
    tagged = F.exists("lines", lambda x: x.contains("<") & x.rlike(r"(?i)<table(?:\s|>|\z)"))
    docs = docs.withColumn("_tagged", tagged)
    docs = docs.withColumn("_parts", _parts(fences)(F.when(F.col("_tagged"), F.col("lines"))))
    return reflowed(docs.withColumn("_parts", F.when(F.col("_tagged"), F.col("_parts"))), "_parts").select("doc_id", "lines")

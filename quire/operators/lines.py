"""Documents as arrays of lines, lines as rows, and the fence state of each line.

A document is (doc_id, lines array<string>). Operators take and return that shape. Those that need
neighbours carry a state from line to line, and shuffle nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import let, scan

# Patterns of quote marks and fences.
_QUOTE = re.compile(r"[\s]*(?:>[\s]*)+")
_FENCE = re.compile(r"[ \t  - 　]*(`{3,}|~{3,})([^\r\n]*)\Z")
_BLANKS, _SPACES = r"[\p{IsWhite_Space}\x1c-\x1f]*", r"[ \t\xa0\u2000-\u200a\u3000]*"
_SPARK_QUOTE, _SPARK_FENCE, _SPARK_BARE = rf"^({_BLANKS}(?:>{_BLANKS})+)", rf"^{_SPACES}(`{{3,}}|~{{3,}})[^\r\n]*\z", rf"^{_SPACES}(?:`{{3,}}|~{{3,}})[ \t]*\z"


def split_lines(text: Column) -> Column:
    """A text's lines; \\n and \\r\\n end one, an empty text has none."""
    parts = F.split(text, "\r?\n", -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(cut)


def join_lines(lines: Column) -> Column:
    """Lines as a text that ends in a newline; no lines give the empty text."""
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def fence_line(line: str) -> tuple[int, tuple[str, int, bool] | None]:
    """A line's quote depth and, if it is a fence, its mark, length and whether nothing stands behind it."""
    quote = _QUOTE.match(line) if ">" in line else None
    inner = line[quote.end() :] if quote else line
    found = _FENCE.match(inner) if "```" in inner or "~~~" in inner else None
    return quote[0].count(">") if quote else 0, (found[1][0], len(found[1]), not found[2].strip(" \t")) if found else None


class FenceState:
    """What a line-by-line reader knows of fenced code: the open marker, its length and quote depth."""

    def __init__(self) -> None:
        self.open: tuple[str, int, int] | None = None
        self.block = 0

    def read(self, line: str) -> tuple[bool, bool, bool, int]:
        """(inside before, is a marker, inside after, number of the fence block)."""
        depth, found = fence_line(line)
        was_in = self.open is not None and depth >= self.open[2]
        if self.open and depth < self.open[2]:
            self.open = None
        if found:
            char, length, bare = found
            if self.open is None:
                self.open = (char, length, depth)
                self.block += 1
            elif depth == self.open[2] and char == self.open[0] and length >= self.open[1] and bare:
                self.open = None
        return was_in, found is not None, self.open is not None and depth >= self.open[2], self.block


def _fence_parts(line: Column) -> Column:
    """struct(depth, mark, bare): a line's quote depth, its fence mark (empty for none), and whether nothing stands
    behind that."""
    has_mark = line.contains("```") | line.contains("~~~")

    def parts(quote: Column) -> Column:
        depth = F.length(quote) - F.length(F.replace(quote, F.lit(">"), F.lit("")))
        inner = F.substr(line, F.length(quote) + 1)
        mark = F.when(has_mark, F.regexp_extract(inner, _SPARK_FENCE, 1)).otherwise("")
        return F.struct(depth.alias("depth"), mark.alias("mark"), (has_mark & inner.rlike(_SPARK_BARE)).alias("bare"))

    return let(F.when(line.contains(">"), F.regexp_extract(line, _SPARK_QUOTE, 1)).otherwise(""), parts)


def _after_line(state: Column, line: Column) -> Column:
    """The fence state behind a line, as FenceState.read() has it: open is the mark that opened a block, empty outside."""
    inside = line["depth"] >= state["depth"]
    was_in = (state["open"] != "") & inside
    opens, ended = (line["mark"] != "") & ~was_in, (line["depth"] == state["depth"]) & line["bare"] & line["mark"].startswith(state["open"])
    open_ = F.when(opens, line["mark"]).when(was_in & ~((line["mark"] != "") & ended), state["open"]).otherwise("")
    # a line that opens a block is in it, and so is one that leaves it open
    return F.struct(
        open_.alias("open"), F.when(opens, line["depth"]).otherwise(state["depth"]).alias("depth"), (state["block"] + opens.cast("int")).alias("block"),
        was_in.alias("was_in"), (line["mark"] != "").alias("marker"), (open_ != "").alias("is_in"),
    )


def fence_state(lines: Column) -> Column:
    """For each line of an array: was_in, marker, is_in and block. Documents without a run of three
    marks skip the reader."""
    outside = F.struct(F.lit(False).alias("was_in"), F.lit(False).alias("marker"), F.lit(False).alias("is_in"), F.lit(0).alias("block"))
    zero = F.struct(F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit(0).alias("block"), *[F.lit(False).alias(x) for x in ("was_in", "marker", "is_in")])

    def read(lines: Column) -> Column:
        states = scan(F.transform(lines, lambda x: _fence_parts(F.coalesce(x, F.lit("")))), zero, _after_line)
        return F.transform(states, lambda s: F.struct(*[s[x].alias(x) for x in ("was_in", "marker", "is_in", "block")]))

    fenced = lambda x: F.exists(x, lambda line: line.contains("```") | line.contains("~~~"))
    return let(lines, lambda x: F.when(fenced(x), read(x)).otherwise(F.transform(x, lambda _: outside)))


def code_lines(lines: Column) -> Column:
    """For each line of an array whether it is a fence marker or fenced code."""
    return F.transform(fence_state(lines), lambda f: f["marker"] | f["is_in"])


def known_lines(lines: Column) -> Column:
    """Lines without null ones; none for a document of null."""
    return F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull())


def dealt(docs: DataFrame, tasks: int | None) -> DataFrame:
    """Documents in as many partitions, if a number is given. Passes over arrays need none."""
    return docs.repartition(tasks, "doc_id") if tasks else docs


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, fence, code): one row per line; code tells fence markers and what is
    inside. Documents without lines give one row of nulls, so that they aren't lost."""
    zipped = F.arrays_zip(F.col("lines").alias("line"), fence_state(F.col("lines")).alias("fence"))
    rows = docs.select("doc_id", F.posexplode_outer(zipped).alias("line_no", "_x"))
    rows = rows.select("doc_id", F.col("line_no").cast("long"), "_x.line", "_x.fence")
    return rows.withColumn("code", F.coalesce(F.col("fence.marker") | F.col("fence.is_in"), F.lit(False)))


def link_parts(lines: Column, code: Column) -> Column:
    """For each line whether it is the target or title of a link definition on a line of its own, or the blank line that
    stands there instead. It takes no more than the two lines before to tell."""
    titled = lambda line: line.rlike(r"\p{IsWhite_Space}" + X.LINK_TITLE)

    def step(state: Column, x: Column) -> Column:
        line, plain = x["line"], ~x["code"]
        bare = plain & line.contains("]:") & line.rlike(X.BARE_LABEL)
        needs = plain & line.contains("]:") & line.rlike(X.LINK_DEFINITION) & ~line.rlike(X.BARE_LABEL) & ~titled(line) & ~line.rlike(X.FOOTNOTE_DEFINITION)
        target = state["bare"] & plain & line.rlike(X.LINK_TARGET) & X.block_kind(line).isNull()

        def made(target: Column) -> Column:
            wanted = target | (plain & (state["bare"] | state["needs"]) & X.is_blank(line)) | (plain & state["needs"] & line.rlike(r"^\p{IsWhite_Space}{0,3}" + X.LINK_TITLE))
            return F.struct(bare.alias("bare"), (needs | (target & ~titled(line))).alias("needs"), wanted.alias("part"))

        return let(target, made)

    rows = F.zip_with(lines, code, lambda x, c: F.struct(x.alias("line"), c.alias("code")))
    states = scan(rows, F.struct(*[F.lit(False).alias(x) for x in ("bare", "needs", "part")]), step)
    # without a line that others may belong to, there is none
    some = F.exists(lines, lambda x: x.contains("]:") & x.rlike(X.LINK_DEFINITION) & (~x.rlike(X.FOOTNOTE_DEFINITION) | x.rlike(X.BARE_LABEL)))
    return F.when(some, F.transform(states, lambda s: s["part"])).otherwise(F.transform(lines, lambda _: F.lit(False)))


def outside_code(lines: Column, change) -> Column:
    """Each line outside fenced code changed by a column function, the others as they are."""
    return F.zip_with(lines, fence_state(lines), lambda x, f: F.when(f["marker"] | f["is_in"], x).otherwise(change(x)))

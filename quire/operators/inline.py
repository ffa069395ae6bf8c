"""Inline text: tokens, ellipses beside protected spans, and emphasis around inline code."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.arrays import let, scan
from . import spans
from .lines import FenceState, dealt, fence_state, known_lines, link_parts

Token = tuple[str, str, str, str]  # kind, raw, fence, code


def spans_of(line: str) -> list[Token]:
    """Code and text tokens of one line; a run of backticks without a partner is text, and a word part
    right behind a code span belongs to it."""
    out, text = [], 0
    for start, end, size in spans.code_spans(line):
        if start > text:
            out.append(("text", line[text:start], "", ""))
        text = spans.suffix_end(line, end) if end - start > 2 * size else end
        out.append(("code", line[start:text], line[start : start + size], line[start + size : end - size]))
    if text < len(line):
        out.append(("text", line[text:], "", ""))
    return out


def tokens_of(lines: list[str]) -> list[Token]:
    """Tokens of a document: fence lines whole, newlines between lines, code and text within them."""
    out, state = [], FenceState()
    for i, line in enumerate(lines):
        if i:
            out.append(("newline", "\n", "", ""))
        _, marker, inside, _ = state.read(line)
        out += [("fence", line, "", "")] if marker or inside else spans_of(line)
    return out


_TOKENS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "raw", "fence", "code")]))
_TOKENS_ARROW = pa.list_(pa.struct([(x, pa.string()) for x in ("kind", "raw", "fence", "code")]))


@F.arrow_udf(_TOKENS)
def _tokens(column: pa.Array) -> pa.Array:
    names = ("kind", "raw", "fence", "code")
    return pa.array([[dict(zip(names, t)) for t in tokens_of(lines or [])] for lines in column.to_pylist()], _TOKENS_ARROW)


def tokenize(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, raw, fence, code): every token of every document, in order of pos."""
    return docs.select("doc_id", F.posexplode(_tokens("lines")).alias("pos", "t")).select("doc_id", F.col("pos").cast("long"), "t.*")


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: A line without any of these has no literal span.
_MAY_BE_LITERAL = r"[`\[<:/\\]|www\."


@F.arrow_udf(T.ArrayType(T.ArrayType(_SPAN)))
def _literal(column: pa.Array) -> pa.Array:
    # Spark counts code points, as Python does
    of = lambda x: [{"start": a, "end": b} for a, b in spans.literal_spans(x)] if x else []
    return pa.array([[of(x) for x in lines] if lines else [] for lines in column.to_pylist()], pa.list_(_SPANS_ARROW))


def merged_spans(found: Column) -> Column:
    """The union of an array of (start, end): sorted, without overlaps, those that touch being one."""
    none = F.array().cast(T.ArrayType(_SPAN))

    def add(done: Column, one: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], one["end"]).alias("end"))
        met = (F.size(done) > 0) & (one["start"] <= last["end"])
        return F.when(met, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(F.array_sort(found), none, add)


def ellipsis_outside(c: Column, literal: Column) -> Column:
    """Dot runs as ellipses except inside spans, which are sorted and don't overlap."""

    def add(done: Column, one: Column) -> Column:
        before, own = F.substr(c, done["at"] + 1, one["start"] - done["at"]), F.substr(c, one["start"] + 1, one["end"] - one["start"])
        return F.struct(one["end"].alias("at"), F.concat(done["text"], X.dots_to_ellipsis(before), own).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    whole = F.aggregate(literal, start, add, lambda done: F.concat(done["text"], X.dots_to_ellipsis(F.substr(c, done["at"] + 1, F.length(c)))))
    return F.when(~c.contains("..."), c).when(F.size(literal) > 0, whole).otherwise(X.dots_to_ellipsis(c))


def _indented_code(lines: Column, states: Column) -> Column:
    """For each line whether it is indented code: its run of indented or blank lines holds one so far that begins right
    after the start, a blank line, a heading, a link definition, a directive or a fence."""

    def row(x: Column, f: Column) -> Column:
        opens = F.coalesce(X.is_blank(x) | X.block_kind(x).isin("heading", "link_reference_definition", "markdownlint_directive") | f["marker"], F.lit(False))
        return F.struct(opens.alias("opens"), (X.indent_columns(x) >= 4).alias("indented"), X.is_blank(x).alias("blank"))

    def step(state: Column, x: Column) -> Column:
        begun = ((x["indented"] | x["blank"]) & state["begun"]) | (state["opens"] & x["indented"])
        return let(begun, lambda b: F.struct(x["opens"].alias("opens"), b.alias("begun"), (b & x["indented"] & ~x["blank"]).alias("code")))

    zero = F.struct(F.lit(True).alias("opens"), F.lit(False).alias("begun"), F.lit(False).alias("code"))
    found = F.transform(scan(F.zip_with(lines, states, row), zero, step), lambda s: s["code"])
    return F.when(F.exists(lines, lambda x: X.indent_columns(x) >= 4), found).otherwise(F.transform(lines, lambda _: F.lit(False)))


def replace_ellipsis(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ellipses for dot runs, outside fenced and indented code, link definitions and protected spans.

    Indented lines are code when their run of indented or blank lines holds one that begins right after
    the start, a blank line, a heading, a link definition, a directive or a fence."""
    lines, dots = F.col("lines"), lambda x: x.contains("...")
    docs = dealt(docs, tasks).select("doc_id", known_lines(lines).alias("lines"))
    docs = docs.withColumn("_states", F.when(F.exists("lines", dots), let(lines, fence_state)))
    docs = docs.withColumn("_indented", F.when(F.col("_states").isNotNull(), _indented_code(lines, F.col("_states"))))
    code = F.transform("_states", lambda f: f["marker"] | f["is_in"])
    docs = docs.withColumn("_parts", let(code, lambda c: F.when(c.isNotNull(), link_parts(lines, c))))
    # lines in which dots are to be replaced, null for others
    free = lambda x: dots(x) & ~F.coalesce(X.block_kind(x) == "link_reference_definition", F.lit(False))
    kept = F.zip_with(F.zip_with("_states", "_indented", lambda f, i: f["marker"] | f["is_in"] | i), "_parts", lambda c, p: c | p)
    docs = docs.withColumn("_free", F.zip_with("lines", kept, lambda x, c: F.when(~c & free(x), x))).drop("_states", "_indented", "_parts")
    asked = F.transform("_free", lambda x: F.when(x.rlike(_MAY_BE_LITERAL), x))
    docs = docs.withColumn("_asked", F.when(F.exists(asked, lambda x: x.isNotNull()), asked))
    docs = docs.withColumn("_spans", _literal("_asked"))
    made = F.zip_with("_free", "_spans", lambda x, found: F.when(x.isNotNull(), ellipsis_outside(x, merged_spans(F.coalesce(found, F.array().cast(T.ArrayType(_SPAN)))))))
    done = F.zip_with(lines, F.when(F.col("_free").isNotNull(), made), lambda x, new: F.coalesce(new, x))
    return docs.select("doc_id", F.coalesce(done, lines).alias("lines"))


_MARKS = re.compile(r"[*_]+")
#: A text without these has no emphasis that touches code.
HAS_EMPHASIS = r"`[*_]|[*_]`"


def _fenced(code: str) -> str:
    longest = max(map(len, re.findall("`+", code)), default=0)
    return "`" * (longest + 1) + code + "`" * (longest + 1)


def emphasis_of(tokens: list[Token]) -> str:
    """The text of tokens with emphasis marks that touch code moved to its outside or dropped."""
    out, pending, rest = [], "", [list(t) for t in tokens]
    for i, (kind, raw, fence, code) in enumerate(rest):
        after = rest[i + 1] if i + 1 < len(rest) else None
        if kind == "text":
            if raw and after and after[0] == "code":
                lead = _MARKS.match(raw)
                if lead and lead.end() == len(raw):
                    pending = raw
                    continue
                tail = re.search(r"[*_]+\Z", raw)
                cut = tail.start() if tail else len(raw)
                out.append(raw[:cut])
                pending = raw[cut:]
            else:
                out.append(raw)
        elif kind == "code":
            glued = raw[2 * len(fence) + len(code) :]
            body, before, behind = raw, "", ""
            text = after[1] if after and after[0] == "text" else ""
            marks = (m[0] if (m := _MARKS.match(text)) else "") if not glued else ""
            if pending and text == pending and not glued:
                before = behind = pending
                after[1] = ""
            elif marks:
                after[1] = text[len(marks) :]
                if not pending:
                    before = marks
                elif not after[1]:
                    before, behind = pending, marks
            else:
                before = pending
            if pending or marks:
                body = _fenced(code) + glued
            out.append(before + body + behind)
            pending = ""
        else:
            out.append(raw)
    return "".join(out)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _emphasis(column: pa.Array) -> pa.Array:
    return pa.array([emphasis_of(tokens_of(lines or [])).split("\n") if lines else lines for lines in column.to_pylist()], pa.list_(pa.string()))


def fix_code_emphasis(docs: DataFrame) -> DataFrame:
    """Documents with emphasis around inline code repaired; those without any skip the reader."""
    touched = F.exists("lines", lambda x: x.rlike(HAS_EMPHASIS))
    return docs.withColumn("lines", F.when(touched, _emphasis(F.when(touched, F.col("lines")))).otherwise(F.col("lines")))


def original(token: Token) -> str:
    """The text that a token was read from."""
    return token[1]


def text_lines(text: str, blanks: int = 0) -> list[str]:
    """The lines of a rewritten text, a newline at its end giving an empty last one; at least blanks empty
    lines at the end, unless there is no text at all."""
    if not text:
        return []
    *ended, last = text.split("\n")
    lines = [*(x.removesuffix("\r") for x in ended), last]
    return lines + [""] * (blanks - _blanks(lines))


def _blanks(lines: list[str]) -> int:
    return next((i for i, x in enumerate(reversed(lines)) if x), len(lines))


def process_tokens(docs: DataFrame, change: Callable[[Token], str]) -> DataFrame:
    """Documents rewritten token by token: change gets (kind, raw, fence, code) and returns the text to
    put in its place. Empty lines at the end stay, and so do documents of nothing else. It runs on the
    executors."""

    def one(lines: list[str] | None) -> list[str] | None:
        if not lines or (blanks := _blanks(lines)) == len(lines):
            return lines
        return text_lines("".join(map(change, tokens_of(lines))), blanks)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def rewritten(column: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in column.to_pylist()], pa.list_(pa.string()))

    return docs.withColumn("lines", rewritten("lines"))

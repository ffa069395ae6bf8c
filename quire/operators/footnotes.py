"""Footnotes: bare numbers to references, trailing lists to definitions, numbers by first use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import first_where, last_where, let, part, scan
from .lines import code_lines, dealt, known_lines

# Patterns of headings, list lines, definitions and references, also those of bare_numbers().
ATX = r"^(?:\p{IsWhite_Space}*(?:>|[-*+]|[0-9]+[.)])\p{IsWhite_Space}*)*\p{IsWhite_Space}*#{1,6}(?:\p{IsWhite_Space}|\z)"
LIST_LINE = r"^(\p{IsWhite_Space}*)([0-9]+)[.:](\p{IsWhite_Space}+)(.*)\z"
DEFINITION = r"^((?:\p{IsWhite_Space}*>\p{IsWhite_Space}*)*\p{IsWhite_Space}*)\[\^([0-9]+)\]\p{IsWhite_Space}*:(.*)\z"
_ANY_DEFINITION = r"^[\p{IsWhite_Space}>]*\[\^[0-9]*\]:"
_TOGGLE = r"^[\p{IsWhite_Space}>]*(?:```|~~~)"
REFERENCE = r"\[\^([0-9]+)\]"
#: A line without these has no number that bare_numbers() converts.
_MAY_BE_BARE = r"[.!?);:][*_]*[0-9]|[0-9]\p{IsWhite_Space}*:"
#: Code spans and what lies between them; an odd run of backticks stands alone.
_PIECES = r"(?s)(?:(`+)(?:(?!`).)+?\1(?!`))|[^`]+|`+"


def outside_spans(line: Column, change) -> Column:
    """A line with a column function applied to what is outside inline code."""
    pieces = F.when(line.contains("`"), F.regexp_extract_all(line, F.lit(_PIECES), F.lit(0))).otherwise(F.array(line))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("`"), p).otherwise(change(p))), "")


def bare_numbers(c: Column) -> Column:
    """word.7 as word.[^7], and word 7: as word[^7]: ."""
    c = F.regexp_replace(c, r"(^|[^0-9])([.!?);:])([*_]*)([0-9]+)(\p{IsWhite_Space}|\z)", "$1$2$3[^$4]$5")
    tail = r"([*_]*)([0-9]+)\p{IsWhite_Space}*:(:*)(\p{IsWhite_Space}|\p{Punct}|\z)"
    c = F.regexp_replace(c, r"([\p{IsAlphabetic}\p{N}&&[^0-9]])\p{IsWhite_Space}+" + tail, "$1$2[^$3]:$4$5")
    return F.regexp_replace(c, r"(^|[^\p{IsAlphabetic}\p{N}])(\p{IsWhite_Space}+)" + tail, "$1$2$3[^$4]:$5$6")


def _trailing(lines: Column, fits: Callable[[Column], Column], use: Callable[[Column, Column], Column]) -> Column:
    """use of the bounds of the longest trailing stretch of fitting lines: the place before its first line, and its last
    line's, blank lines at the end left out."""
    odd = lambda end: last_where(part(lines, F.lit(0), end + 1), lambda x: ~fits(x))
    return let(last_where(lines, lambda x: ~X.is_blank(x)), lambda end: let(odd(end), lambda last: use(last, end)))


def _list_block(lines: Column) -> Column:
    """struct(last, end, h2, defined) of the trailing list block, which lies behind last: whether a second-level heading
    and whether a definition comes before it. Null if there is no list item in it."""

    def found(last: Column, end: Column) -> Column:
        before = part(lines, F.lit(0), last + 1)
        shown = let(last_where(before, lambda x: ~X.is_blank(x)), lambda i: F.coalesce(X.ltrim(F.get(lines, i)).startswith("## "), F.lit(False)))
        defined = F.exists(F.arrays_zip(before.alias("line"), code_lines(lines).alias("code")), lambda x: ~x["code"] & x["line"].rlike(_ANY_DEFINITION))
        listed = F.exists(part(lines, last + 1, end + 1), lambda x: x.rlike(LIST_LINE))
        return F.when(listed, F.struct(last.alias("last"), end.alias("end"), shown.alias("h2"), F.coalesce(defined, F.lit(False)).alias("defined")))

    return _trailing(lines, lambda x: X.is_blank(x) | X.rtrim(x).rlike(LIST_LINE) | x.rlike(r"^\p{IsWhite_Space}"), found)


def _promoted(lines: Column) -> Column:
    """Lines with the items of a trailing list under a second-level heading as definitions."""

    def changed(block: Column) -> Column:
        made = lambda x: F.when(x.rlike(LIST_LINE), F.regexp_replace(x, LIST_LINE, "$1[^$2]:$3$4")).otherwise(x)
        items = F.transform(lines, lambda x, i: F.when((i > block["last"]) & (i <= block["end"]), made(x)).otherwise(x))
        return F.when(F.coalesce(block["h2"] & ~block["defined"], F.lit(False)), items).otherwise(lines)

    return F.when(F.exists(lines, lambda x: x.rlike(LIST_LINE)), let(_list_block(lines), changed)).otherwise(lines)


def _open(lines: Column) -> Column:
    """For each line whether it lies in fences or is one; here fence lines are a plain toggle."""
    marks = F.transform(lines, lambda x: x.rlike(_TOGGLE))
    state = lambda s, m: F.struct((s["inside"] != m).alias("inside"), ((s["inside"] != m) | m).alias("open"))
    read = F.transform(scan(marks, F.struct(F.lit(False).alias("inside"), F.lit(False).alias("open")), state), lambda s: s["open"])
    fenced = F.exists(lines, lambda x: (x.contains("```") | x.contains("~~~")) & x.rlike(_TOGGLE))
    return F.when(fenced, read).otherwise(F.transform(lines, lambda _: F.lit(False)))


def _number(text: Column) -> Column:
    """A number, null for no text or one too large."""
    # casts that fail are slow
    return let(text, lambda x: F.when(x != "", x.try_cast("long")))


def _read_line(line: Column, open_: Column) -> Column:
    """struct(line, open, def, refs): the old number that a line defines, and those it refers to."""
    marked = ~open_ & line.contains("[^")
    number = F.when(marked, _number(F.regexp_extract(line, DEFINITION, 2)))

    def read(defined: Column) -> Column:
        plain = outside_spans_only(F.when(defined.isNotNull(), F.regexp_extract(line, DEFINITION, 3)).otherwise(line))
        refs = F.transform(F.regexp_extract_all(plain, F.lit(REFERENCE), F.lit(1)), lambda x: x.try_cast("long"))
        return F.struct(line.alias("line"), open_.alias("open"), defined.alias("def"), F.when(marked, refs).otherwise(F.array().cast("array<long>")).alias("refs"))

    return let(number, read)


def _listed(rows: Column) -> Column:
    """The old number of each row that is an item of a trailing list, null for others; null if there is none."""
    lines = F.transform(rows, lambda r: r["line"])

    def items(block: Column) -> Column:
        referenced = F.exists(rows, lambda r: F.size(r["refs"]) > 0)
        # an item counts behind a definition or in a document with references
        first = F.when(referenced, -1).otherwise(F.coalesce(first_where(rows, lambda r: r["def"].isNotNull()), F.size(rows)))
        within = lambda i, start: (i > block["last"]) & (i <= block["end"]) & (i >= start)
        fits = lambda r: ~r["open"] & r["def"].isNull() & r["line"].rlike(LIST_LINE)
        found = let(first, lambda start: F.transform(rows, lambda r, i: F.when(within(i, start) & fits(r), _number(F.regexp_extract(r["line"], LIST_LINE, 2)))))
        return F.when(~block["defined"], found)

    return F.when(F.exists(lines, lambda x: x.rlike(LIST_LINE)), let(_list_block(lines), items))


def _renumbered_rows(rows: Column, order: Column) -> Column:
    """struct(line, number) of each row, numbers being places in order; null numbers where a row defines nothing."""
    new = lambda old: F.nullif(F.array_position(order, old), F.lit(0).cast("long"))
    mapped = lambda c: outside_spans(c, lambda p: _renumbered(p, new))

    def made(r: Column) -> Column:
        line, own = r["line"], F.coalesce(new(r["def"]), new(r["list"]))

        def written(number: Column) -> Column:
            mark = F.concat(F.lit("[^"), number.cast("string"), F.lit("]:"))
            cut = lambda pattern, i: F.regexp_extract(line, pattern, i)
            defined, listed = r["def"].isNotNull(), r["list"].isNotNull()
            head = F.when(defined, F.concat(cut(DEFINITION, 1), mark)).when(listed, F.concat(cut(LIST_LINE, 1), mark, cut(LIST_LINE, 3))).otherwise("")
            rest = F.when(defined, cut(DEFINITION, 3)).when(listed, cut(LIST_LINE, 4)).otherwise(line)
            text = F.when(r["open"], line).otherwise(F.concat(head, let(rest, lambda x: F.when(x.contains("[^"), mapped(x)).otherwise(x))))
            return F.struct(text.alias("line"), number.alias("number"))

        return let(own, written)

    return F.transform(rows, made)


def _with_items(rows: Column) -> Column:
    """Rows with list, the old number of an item of a trailing list."""
    kept = lambda r, items, i: F.struct(*[r[x].alias(x) for x in ("line", "open", "def", "refs")], F.get(items, i).alias("list"))
    return let(_listed(rows), lambda items: F.transform(rows, lambda r, i: kept(r, items, i)))


def _numbered(rows: Column) -> Column:
    """struct(line, number) of each row, numbered by first use."""
    # a document's old numbers in the order in which they get new ones: references, definitions, list
    # items from the last up
    of = lambda name: F.transform(rows, lambda r: r[name])
    old = F.concat(F.flatten(of("refs")), of("def"), F.reverse(of("list")))
    defined = F.exists(rows, lambda r: r["def"].isNotNull() | r["list"].isNotNull())
    same = F.transform(rows, lambda r: F.struct(r["line"].alias("line"), F.lit(None).cast("long").alias("number")))
    skip = lambda order: (F.size(order) == 0) | (~defined & F.exists(rows, lambda r: r["line"].rlike(LIST_LINE)))
    return let(F.array_distinct(F.filter(old, lambda x: x.isNotNull())), lambda order: F.when(skip(order), same).otherwise(_renumbered_rows(rows, order)))


def convert_footnotes(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Documents with footnotes in reference syntax, numbered by first use, definitions in that order.

    References are numbered 1, 2, ... as they first occur outside fences (here a plain toggle on fence
    lines); definitions follow with their mapped or next numbers, and items of a trailing list after
    them from the last up. A trailing block of definitions is sorted by the new numbers, continuation
    lines with their definition. Needs no shuffle."""
    bare = lambda x: F.when(x.rlike(_MAY_BE_BARE) & ~x.rlike(ATX), outside_spans(x, bare_numbers)).otherwise(x)
    docs = dealt(docs, tasks).select("doc_id", F.transform(known_lines(F.col("lines")), bare).alias("lines"))
    # without such a mark or a list, there is nothing to number
    noted = F.exists("lines", lambda x: x.contains("[^") | x.rlike(LIST_LINE))
    docs = docs.withColumn("_rows", F.when(noted, let(_promoted(F.col("lines")), lambda x: F.zip_with(x, _open(x), _read_line))))
    for step in (_with_items, _numbered, _ordered_definitions):
        docs = docs.withColumn("_rows", let(F.col("_rows"), step))
    return docs.select("doc_id", F.coalesce("_rows", "lines").alias("lines"))


def outside_spans_only(c: Column) -> Column:
    """What is outside inline code, code spans replaced by a blank."""
    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))
    return F.when(c.contains("`"), F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("`"), F.lit(" ")).otherwise(p)), "")).otherwise(c)


def _renumbered(c: Column, new: Callable[[Column], Column]) -> Column:
    """References with their new numbers; unknown ones stay."""
    refs = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
    gaps = F.split(c, REFERENCE, -1)
    written = F.transform(refs, lambda x: F.concat(F.lit("[^"), F.coalesce(new(x.try_cast("long")).cast("string"), x), F.lit("]")))
    return F.when(c.contains("[^"), F.array_join(F.zip_with(gaps, written, lambda g, r: F.concat(F.coalesce(g, F.lit("")), F.coalesce(r, F.lit("")))), "")).otherwise(c)


def _ordered_definitions(rows: Column) -> Column:
    """The lines of rows (line, number), those of a trailing block of definitions sorted by number; what follows a
    definition stays with it. An empty line right before a definition is its own, unless it is the block's first; that
    of the definition which comes first goes behind it. Other lines before the first one stay in front."""
    lines = F.transform(rows, lambda r: r["line"])
    text = lambda start, end: F.transform(part(rows, start, end), lambda r: r["line"])

    def ordered(heads: Column, end: Column) -> Column:
        # the places where a definition, or the empty line that is its own, begins
        gap = lambda i, k: (k > 0) & (F.get(rows, i - 1)["line"] == "")
        starts = F.transform(heads, lambda h, k: F.struct(h["number"].alias("number"), h["at"].alias("at"), gap(h["at"], k).alias("gap")))

        def sorted_by_number(starts: Column) -> Column:
            def own(s: Column, k: Column) -> Column:
                below = F.get(starts, k + 1)
                stop = F.coalesce(below["at"] - below["gap"].cast("int"), end + 1)
                return F.struct(s["number"].alias("number"), s["at"].alias("at"), s["gap"].alias("gap"), text(s["at"], stop).alias("lines"))

            empty = lambda wanted: F.when(wanted, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            blocks = F.transform(
                F.sort_array(F.transform(starts, own)), lambda b, k: F.concat(empty(b["gap"] & (k > 0)), b["lines"], empty(b["gap"] & (k == 0)))
            )
            first = F.get(starts, F.lit(0))["at"]
            return F.concat(text(F.lit(0), first), F.flatten(blocks), text(end + 1, F.size(rows)))

        return let(starts, sorted_by_number)

    def within(last: Column, end: Column) -> Column:
        heads = F.filter(F.transform(rows, lambda r, i: F.struct(r["number"].alias("number"), i.alias("at"))), lambda h: (h["at"] > last) & (h["at"] <= end) & h["number"].isNotNull())
        return let(heads, lambda x: F.when(F.size(x) > 0, ordered(x, end)).otherwise(lines))

    block = _trailing(lines, lambda x: X.is_blank(x) | x.rlike(DEFINITION) | x.rlike(r"^\p{IsWhite_Space}"), within)
    return F.when(F.exists(rows, lambda r: r["number"].isNotNull()), block).otherwise(lines)

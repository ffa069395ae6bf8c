"""Breaks, underlined headings, list numbers and fenced code blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import change, let, part, replaced, scan
from .lines import code_lines, dealt, fence_state, known_lines, outside_code

# Patterns of fences, language names and list items.
LOCAL_FENCE = r"^(\p{IsWhite_Space}*)(`{3,}|~{3,})([A-Za-z0-9_+.,-]*)\p{IsWhite_Space}*\z"
ORPHAN = r"^[A-Za-z0-9_+.-]*[A-Za-z0-9_+\-](?:,[A-Za-z0-9_+.-]*[A-Za-z0-9_+\-])*\z"
ITEM = r"^(\p{IsWhite_Space}*)[1-9][0-9]*\.(\p{IsWhite_Space}+)(.*)"


def _fenced(lines: Column) -> Column:
    return F.exists(lines, lambda x: x.contains("```") | x.contains("~~~"))


def _with_states(lines: Column) -> Column:
    """struct(at, line, and the fence state) of each line."""
    row = lambda x, f: F.struct(x.alias("line"), f["was_in"].alias("was_in"), f["marker"].alias("marker"), f["is_in"].alias("is_in"))
    placed = lambda r, i: F.struct(i.alias("at"), *[r[x].alias(x) for x in ("line", "was_in", "marker", "is_in")])
    return F.transform(F.zip_with(lines, fence_state(lines), row), placed)


def format_breaks(docs: DataFrame) -> DataFrame:
    """Thematic breaks outside fenced code as BREAK_LENGTH underscores. Needs no shuffle."""
    change = lambda x: F.when(X.rtrim(x).rlike(X.BREAK), F.lit("_" * X.BREAK_LENGTH)).otherwise(x)
    return docs.withColumn("lines", outside_code(F.col("lines"), change))


def _heading(line: Column, below: Column) -> Column:
    """The heading that a line makes with the underline below it, null for none."""
    own, under = (F.regexp_extract(c, r"^([\p{IsWhite_Space}>]*)", 1) for c in (line, below))

    def shared(own: Column, under: Column) -> Column:
        common = F.array_max(F.filter(F.sequence(F.lit(0), F.length(own)), lambda i: F.substr(own, F.lit(1), i) == F.substr(under, F.lit(1), i)))
        return F.when(own == under, F.length(own)).otherwise(common)

    def made(x: Column) -> Column:
        own, under, shared, text, rule = (x[i] for i in ("own", "under", "shared", "text", "rule"))
        apart = (own != under) | (F.substr(text, F.lit(1), F.lit(1)) != F.substr(rule, F.lit(1), F.lit(1)))
        fits = (F.octet_length(own) == F.octet_length(under)) & (text != "") & rule.rlike(r"^(={3,}|-{3,})\z") & apart
        lead = F.substr(line, F.lit(1), shared)
        return F.when(fits, F.concat(lead, F.when(lead.endswith(">"), " ").otherwise(""), F.when(rule.startswith("="), "# ").otherwise("## "), text))

    def cut(x: Column) -> Column:
        after = lambda c: X.trim(F.substr(c, x["shared"] + 1))
        return let(F.struct(*[x[i].alias(i) for i in ("own", "under", "shared")], after(line).alias("text"), after(below).alias("rule")), made)

    found = lambda x: let(F.struct(x["own"].alias("own"), x["under"].alias("under"), shared(x["own"], x["under"]).alias("shared")), cut)
    return let(F.struct(own.alias("own"), under.alias("under")), found)


def setext_headings(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Underlined headings as # and ## headings.

    A line whose successor is an underline under an indent with quote marks of the same length in bytes
    is a candidate; what both begin with stays before the heading. An underline that is used can't be a
    heading itself, so of each island of consecutive candidates the first, third and so on become
    headings, and the lines after them go."""
    lines, ruled = F.col("lines"), lambda x: x.rlike(r"(?:={3,}|-{3,})\p{IsWhite_Space}*\z")
    docs = dealt(docs, tasks).select("doc_id", known_lines(lines).alias("lines"))

    def candidates(code: Column) -> Column:
        above = lambda i: F.coalesce(ruled(F.get(lines, i + 1)) & ~F.get(code, i), F.lit(False))
        made = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.when(above(i), F.when(~X.is_blank(x), _heading(x, F.get(lines, i + 1)))).alias("made")))
        return F.filter(made, lambda x: x["made"].isNotNull())

    # of candidates that follow each other, each second one is an underline only
    zero = F.struct(F.lit(-2).alias("at"), F.lit("").alias("made"), F.lit(False).alias("is"))
    step = lambda s, x: F.struct(x["at"].alias("at"), x["made"].alias("made"), (~s["is"] | (s["at"] + 1 != x["at"])).alias("is"))
    docs = docs.withColumn("_found", F.when(F.exists("lines", ruled), let(code_lines(lines), candidates)))
    used = F.filter(let(F.col("_found"), lambda x: scan(x, zero, step)), lambda x: x["is"])
    docs = docs.withColumn("_found", F.transform(used, lambda x: change(x["at"], x["at"] + 2, F.array(x["made"]))))
    return docs.select("doc_id", F.coalesce(replaced(lines, F.col("_found")), lines).alias("lines"))


def item_threshold(line: Column, code: Column, blank_before: Column) -> tuple[Column, Column, Column]:
    """Whether a line is an ordered item, its indent in columns, and the indent above which it ends all lists (null if it
    ends none)."""
    blank = X.is_blank(line)
    indent = F.length(F.regexp_replace(X.leading_indent(line), "\t", "    "))
    item = F.coalesce(~code & line.rlike(ITEM), F.lit(False))
    plain = line.rlike(r"^\p{IsWhite_Space}*[*_`]*[\p{IsAlphabetic}\p{N}]")
    reset = line.rlike(X.HEADING) | X.rtrim(line).rlike(X.BREAK)
    threshold = F.when(item, indent).when(reset, -1).when(blank_before & plain, indent - 1).otherwise(indent)
    return item, indent, F.when(~code & ~blank, threshold)


def numbered_item(line: Column, number: Column) -> Column:
    """An ordered item with another number."""
    part = lambda i: F.regexp_extract(line, ITEM, i)
    rest = F.substr(line, F.length(F.regexp_extract(line, r"^(\p{IsWhite_Space}*[1-9][0-9]*\.\p{IsWhite_Space}+)", 1)) + 1)
    return F.concat(part(1), number.cast("string"), F.lit("."), part(2), rest)


def renumber_lists(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ordered list items numbered from 1 at every indent.

    Every line that isn't blank or code is an event with a threshold; it ends all lists of a larger
    indent. An item's number counts the items of its indent since the last event below that indent: the open
    lists, at most one for an indent, are carried from line to line."""
    lines = F.col("lines")
    docs = dealt(docs, tasks).select("doc_id", known_lines(lines).alias("lines"))

    def events(states: Column) -> Column:
        state = lambda i: F.get(states, i)
        blank_before = lambda i: F.coalesce(X.is_blank(F.get(lines, i - 1)) & ~state(i - 1)["marker"], F.lit(False))

        def event(x: Column, i: Column) -> Column:
            item, indent, below = item_threshold(x, state(i)["marker"] | state(i)["is_in"], blank_before(i))
            return F.struct(item.alias("item"), indent.alias("indent"), below.alias("below"))

        return F.transform(lines, event)

    def step(state: Column, x: Column) -> Column:
        open_ = F.when(x["below"].isNull(), state["open"]).otherwise(F.filter(state["open"], lambda o: o["indent"] <= x["below"]))

        def counted(open_: Column) -> Column:
            number = F.coalesce(F.array_max(F.filter(open_, lambda o: o["indent"] == x["indent"])["n"]), F.lit(0)) + 1
            new = lambda n: F.concat(F.filter(open_, lambda o: o["indent"] != x["indent"]), F.array(F.struct(x["indent"].alias("indent"), n.alias("n"))))
            with_item = let(number, lambda n: F.struct(new(n).alias("open"), n.alias("number")))
            return F.when(x["item"], with_item).otherwise(F.struct(open_.alias("open"), F.lit(None).cast("int").alias("number")))

        return let(open_, counted)

    zero = F.struct(F.array().cast("array<struct<indent:int,n:int>>").alias("open"), F.lit(None).cast("int").alias("number"))
    docs = docs.withColumn("_events", F.when(F.exists("lines", lambda x: x.rlike(ITEM)), let(fence_state(lines), events)))
    docs = docs.withColumn("_numbers", let(F.col("_events"), lambda x: F.transform(scan(x, zero, step), lambda s: s["number"])))
    made = F.zip_with(lines, "_numbers", lambda x, n: F.when(n.isNotNull(), numbered_item(x, n)).otherwise(x))
    return docs.select("doc_id", F.coalesce(made, lines).alias("lines"))


def _rewritten(line: Column, marker: Column) -> Column:
    """A fence line with another marker, without a language that is null."""
    language = F.regexp_extract(line, LOCAL_FENCE, 3)
    return F.concat(F.regexp_extract(line, LOCAL_FENCE, 1), marker, F.when(language.rlike(r"(?i)^null\z"), "").otherwise(language))


def compress_fences(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Fence delimiters as three backticks, unless a line inside a block could then be taken for its
    end; the word null goes from both delimiters. An unclosed last block has only its first line changed."""
    docs = dealt(docs, tasks).select("doc_id", known_lines(F.col("lines")).alias("lines"))
    opens, closes, inside = (lambda m: ~m["was_in"]), (lambda m: m["was_in"] & ~m["is_in"]), (lambda m: m["was_in"] & m["is_in"])
    mark = lambda m: F.substr(F.regexp_extract(m["line"], r"(`{3,}|~{3,})", 1), F.lit(1), F.lit(1))

    def block(marks: Column, last_open: Column) -> Column:
        """Changes of a block: its marker lines, and whether it is the last one and open at the end."""
        first, ends = F.get(marks, F.lit(0)), F.filter(marks, lambda m: opens(m) | closes(m))
        good = F.forall(ends, lambda m: m["line"].rlike(LOCAL_FENCE))
        conflict = F.exists(marks, lambda m: inside(m) & ((mark(m) == mark(first)) | (mark(m) == "`")))
        own = lambda m, c: F.when(c, F.regexp_extract(m["line"], LOCAL_FENCE, 2)).otherwise("```")
        one = lambda m, marker: change(m["at"], m["at"] + 1, F.array(_rewritten(m["line"], marker)))
        both = let(conflict, lambda c: F.transform(ends, lambda m: one(m, own(m, c))))
        closed = F.exists(marks, closes)
        return F.when(closed & good, both).when(~closed & last_open & first["line"].rlike(LOCAL_FENCE), F.array(one(first, F.lit("```"))))

    def changes(marks: Column, open_at_end: Column) -> Column:
        starts = F.filter(F.transform(marks, lambda m, k: F.when(opens(m), k)), lambda k: k.isNotNull())
        each = lambda starts: F.transform(
            starts, lambda k, j: let(part(marks, k, F.coalesce(F.get(starts, j + 1), F.size(marks))), lambda x: block(x, open_at_end & (j + 1 == F.size(starts))))
        )
        return F.flatten(F.filter(let(starts, each), lambda x: x.isNotNull()))

    docs = docs.withColumn("_rows", F.when(_fenced(F.col("lines")), let(F.col("lines"), _with_states)))
    # an open block's last line is in it
    shown = F.struct(F.filter("_rows", lambda r: r["marker"]).alias("marks"), F.element_at("_rows", -1)["is_in"].alias("open"))
    docs = docs.withColumn("_marks", F.when(F.col("_rows").isNotNull(), shown)).drop("_rows")
    docs = docs.withColumn("_changes", let(F.col("_marks"), lambda m: changes(m["marks"], m["open"])))
    return docs.select("doc_id", F.coalesce(replaced(F.col("lines"), F.col("_changes")), "lines").alias("lines"))


def attach_orphan_specifiers(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """A language name on a line of its own, after a blank line and before an unlabelled fence, moves
    onto the fence; the blank lines between them go."""
    docs = dealt(docs, tasks).select("doc_id", known_lines(F.col("lines")).alias("lines"))

    def spec(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(X.trim(line), ","), X.trim), lambda x: x != "")
        return F.array_join(parts, ",")

    def moved(name: Column, fence: Column, spec: Column) -> Column:
        """The change of an unlabelled fence and the line with a name before it, both among those that aren't blank."""
        own, indent = F.regexp_extract(fence["line"], LOCAL_FENCE, 1), X.leading_indent(name["line"])
        before = F.when((own == "") | indent.startswith(own), indent).otherwise(own)
        return change(name["at"], fence["at"] + 1, F.array(F.concat(before, F.regexp_extract(fence["line"], LOCAL_FENCE, 2), spec)))

    def changes(rows: Column) -> Column:
        """Of rows that aren't blank."""

        def one(fence: Column, k: Column) -> Column:
            name, above = F.get(rows, k - 1), F.get(rows, k - 2)
            unlabelled = fence["line"].rlike(LOCAL_FENCE) & F.regexp_extract(fence["line"], LOCAL_FENCE, 3).rlike("(?i)^(null)?\\z")
            free = (name["at"] == 0) | F.coalesce(above["at"] + 1 < name["at"], F.lit(True))
            fits = fence["marker"] & ~fence["was_in"] & ~name["was_in"] & ~name["marker"] & free
            return F.when(F.coalesce(fits, F.lit(False)), F.when(unlabelled, let(spec(name["line"]), lambda s: F.when(s.rlike(ORPHAN), moved(name, fence, F.lower(s))))))

        return F.filter(F.transform(rows, one), lambda x: x.isNotNull())

    docs = docs.withColumn("_rows", F.when(_fenced(F.col("lines")), let(F.col("lines"), _with_states)))
    docs = docs.withColumn("_rows", F.filter("_rows", lambda r: ~X.is_blank(r["line"])))
    docs = docs.withColumn("_changes", let(F.col("_rows"), changes))
    return docs.select("doc_id", F.coalesce(replaced(F.col("lines"), F.col("_changes")), "lines").alias("lines"))

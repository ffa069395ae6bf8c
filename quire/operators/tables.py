"""Pipe tables: detection as gaps and islands, then reflow of each block to even column widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import let, part, scan
from .lines import code_lines, dealt, explode_lines, known_lines

Cells = Column  # array<array<string>>


def _starts(line: Column, code: Column) -> Column:
    """Whether a line can start a table."""
    return F.coalesce(~code & line.contains("|") & X.ltrim(line).startswith("|") & (X.indent_columns(line) < 4), F.lit(False))


def _goes_on(line: Column, code: Column) -> Column:
    """Whether a line continues one, besides those that start one."""
    shape = line.contains("|") | line.rlike(X.SEPARATOR)
    return F.coalesce(~code & shape & ~X.is_blank(line) & X.block_kind(line).isNull() & (X.indent_columns(line) < 4), F.lit(False))


def find_tables(rows: DataFrame) -> DataFrame:
    """Exploded lines with table_id, null outside tables.

    A line that begins with a pipe can start a table; lines that hold a pipe or look like a separator
    continue it unless they are blank, indented code or begin another block. Every other line breaks
    a run, so the running count of breakers names the run, and a run's lines from its first starting
    line on are a table."""
    line, w = F.col("line"), Window.partitionBy("doc_id").orderBy("line_no")
    marked = rows.withColumn("_starts", _starts(line, F.col("code")))
    goes_on = F.col("_starts") | _goes_on(line, F.col("code"))
    marked = marked.withColumn("_run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    begun = F.sum(F.col("_starts").cast("int")).over(Window.partitionBy("doc_id", "_run").orderBy("line_no"))
    return marked.withColumn("table_id", F.when(goes_on & (begun > 0), F.col("_run"))).drop("_starts", "_run")


def parts_with_tables(lines: Column, code: Column) -> Column:
    """Lines as stretches (table, block): a letter for each line, and a table from a starting one on."""
    letters = F.array_join(F.zip_with(lines, code, lambda x, c: F.when(_starts(x, c), "s").when(_goes_on(x, c), "g").otherwise("b")), "")

    def cut(parts: Column) -> Column:
        ends = lambda ends: F.zip_with(parts, ends, lambda x, end: F.struct(x.startswith("s").alias("table"), part(lines, end - F.length(x), end).alias("block")))
        return let(scan(parts, F.lit(0), lambda at, x: at + F.length(x)), ends)

    return let(F.regexp_extract_all(letters, F.lit("s[sg]*|[^s]+"), F.lit(0)), cut)


def _empty(c: Column) -> Column:
    return c == ""


def _concatenated(row: Column, width: Column) -> Column:
    """Whether a row is several rows of that width with one empty cell between each two."""
    n = F.size(row)
    count = F.floor((n + 1) / (width + 1)).cast("int")
    gaps = F.forall(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda k: _empty(F.coalesce(F.get(row, k * (width + 1) - 1), F.lit(""))))
    full = F.forall(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda k: F.exists(F.slice(row, k * (width + 1) + 1, width), lambda c: ~_empty(c)),
    )
    return (width > 0) & (n > width) & ((n + 1) % (width + 1) == 0) & (count >= 2) & gaps & full


def _pieces(row: Column, width: Column) -> Column:
    """The rows that a concatenated row holds."""
    count = F.floor((F.size(row) + 1) / (width + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(row, k * (width + 1) + 1, width))


def _is_separator_row(row: Column) -> Column:
    return F.forall(row, lambda c: c.rlike(X.SEPARATOR))


def _read(block: Column) -> Column:
    """struct(indent, sep, cells) of a block: the cells of its separator, and of its other lines."""

    def read(lines: Column) -> Column:
        def cut(at: Column) -> Column:
            sep = F.when(at > 0, X.split_cells(F.get(lines, at - 1)))
            body = F.when(at > 0, F.filter(lines, lambda _, i: i != at - 1)).otherwise(lines)
            return F.struct(X.leading_indent(F.get(block, F.lit(0))).alias("indent"), sep.alias("sep"), F.transform(body, X.split_cells).alias("cells"))

        return let(F.array_position(F.transform(lines, lambda x: x.rlike(X.SEPARATOR)), True).cast("int"), cut)

    return let(F.filter(F.transform(block, X.trim), lambda x: ~x.startswith("\\-")), read)


def _width(cells: Column) -> Column:
    """How many columns a table has: its first row's, or those of the rows that are written behind each other in one."""

    def of(first: Column) -> Column:
        n = F.coalesce(F.size(first), F.lit(0))
        embedded = F.filter(
            F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda w: _concatenated(first, w) & F.exists(_pieces(first, w), lambda r: F.forall(r, lambda x: x.contains("-") & x.rlike(X.SEPARATOR))),
        )
        prefix = F.coalesce(F.array_max(F.transform(first, lambda x, i: F.when(~_empty(x), i + 1).otherwise(0))), F.lit(0))
        later = F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))
        by_prefix = let(prefix, lambda p: F.when((p > 0) & (p < n) & F.exists(later, lambda r: _concatenated(r, p)), p).otherwise(n))
        return let(F.get(embedded, F.lit(0)), lambda w: F.coalesce(w, by_prefix))

    return let(F.get(cells, F.lit(0)), of)


def _logical(x: Column) -> Column:
    """struct(indent, sep, rows, split): rows that stand on one line apart, without those of empty cells only."""

    def of(width: Column) -> Column:
        behind = lambda r: F.slice(r, width + 1, F.greatest(F.size(r) - width, F.lit(0)))
        cut = F.transform(x["cells"], lambda r, i: F.when((i == 0) & (width < F.size(r)) & F.forall(behind(r), _empty), F.slice(r, 1, width)).otherwise(r))

        def apart(cells: Column) -> Column:
            rows = F.flatten(F.transform(cells, lambda r: F.when(_concatenated(r, width), _pieces(r, width)).otherwise(F.array(r))))
            split = F.exists(cells, lambda r: _concatenated(r, width))
            return F.struct(x["indent"].alias("indent"), x["sep"].alias("sep"), F.filter(rows, lambda r: F.exists(r, lambda c: ~_empty(c))).alias("rows"), split.alias("split"))

        return let(cut, apart)

    return let(_width(x["cells"]), of)


def _with_rule(x: Column) -> Column:
    """struct(indent, sep, rows, columns, bad): the separator may be the second row; bad where a block is no table: ragged
    rows, one lone cell, or a separator of another width."""
    rows, second = x["rows"], F.get(x["rows"], F.lit(1))

    def of(columns: Column) -> Column:
        promoted = (x["sep"].isNull() | (F.size(x["sep"]) != columns)) & second.isNotNull() & _is_separator_row(second)
        ragged = ~x["split"] & F.exists(rows, lambda r: (F.size(r) != F.size(F.get(rows, F.lit(0)))) & ~_is_separator_row(r))

        def made(promoted: Column) -> Column:
            sep, left = F.when(promoted, second).otherwise(x["sep"]), F.when(promoted, F.filter(rows, lambda _, i: i != 1)).otherwise(rows)
            lone = sep.isNull() & (F.size(left) == 1) & (F.size(F.get(left, F.lit(0))) == 1)
            bad = ragged | lone | (sep.isNotNull() & (F.size(sep) != columns))
            escaped = F.transform(left, lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))
            return F.struct(x["indent"].alias("indent"), sep.alias("sep"), escaped.alias("rows"), columns.alias("columns"), bad.alias("bad"))

        return let(F.coalesce(promoted, F.lit(False)), made)

    return let(F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)), of)


def _written(x: Column) -> Column:
    """The lines of a table, null where it is bad."""
    # cells with their widths
    shown = F.transform(x["rows"], lambda r: F.transform(r, lambda c: F.struct(c.alias("text"), X.display_width(c).alias("width"))))
    columns = F.when(x["columns"] > 0, F.sequence(F.lit(0), x["columns"] - 1)).otherwise(F.array().cast("array<int>"))
    least = F.when(x["sep"].isNotNull(), 3).otherwise(0)

    def of(rows: Column) -> Column:
        widths = F.transform(columns, lambda j: F.greatest(least, F.array_max(F.transform(rows, lambda r: F.coalesce(F.get(r, j)["width"], F.lit(0))))))

        def lines(widths: Column) -> Column:
            pad = lambda c, j: F.concat(c["text"], F.repeat(F.lit(" "), F.greatest(F.get(widths, j) - c["width"], F.lit(0))))
            written = F.transform(rows, lambda r: F.concat(x["indent"], F.lit("| "), F.array_join(F.transform(r, pad), " | "), F.lit(" |")))
            right = lambda c: c.endswith(":") & (F.length(c) > 1)
            dashes = F.transform(
                x["sep"],
                lambda c, j: F.concat(
                    F.when(c.startswith(":"), ":").otherwise(""),
                    F.repeat(F.lit("-"), F.greatest(F.get(widths, j), F.lit(3)) - c.startswith(":").cast("int") - right(c).cast("int")),
                    F.when(right(c), ":").otherwise(""),
                ),
            )
            rule = F.concat(x["indent"], F.lit("| "), F.array_join(dashes, " | "), F.lit(" |"))
            ruled = lambda w: F.concat(F.slice(w, 1, 1), F.array(rule), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))))
            return let(written, lambda w: F.when(x["sep"].isNotNull(), ruled(w)).otherwise(w))

        return let(widths, lines)

    return F.when(~x["bad"], let(shown, of))


def reflowed(docs: DataFrame, parts: str) -> DataFrame:
    """(doc_id, lines ...) whose column of parts (table, block) becomes lines again, tables reflowed; a block that is no
    table stays. Where it is null, so do the lines."""
    docs = docs.withColumn("_made", F.transform(parts, lambda p: F.when(p["table"], _read(p["block"]))))
    for step in (_logical, _with_rule, _written):
        docs = docs.withColumn("_made", F.transform("_made", lambda x: F.when(x.isNotNull(), step(x))))
    lines = F.flatten(F.zip_with(parts, "_made", lambda p, made: F.coalesce(made, p["block"])))
    return docs.withColumn("lines", F.coalesce(lines, "lines")).drop("_made", parts)


def reflow_tables(docs: DataFrame, ellipsis: bool = False, tasks: int | None = None) -> DataFrame:
    """Documents with every pipe table outside fenced code reflowed; with ellipsis, its dot runs are
    replaced before widths are measured."""
    docs = dealt(docs, tasks).select("doc_id", known_lines(F.col("lines")).alias("lines"))
    some = F.exists("lines", lambda x: x.contains("|") & X.ltrim(x).startswith("|"))
    docs = docs.withColumn("_parts", F.when(some, let(code_lines(F.col("lines")), lambda code: parts_with_tables(F.col("lines"), code))))
    if ellipsis:
        dots = lambda p: F.when(p["table"], F.transform(p["block"], X.dots_to_ellipsis)).otherwise(p["block"])
        docs = docs.withColumn("_parts", F.transform("_parts", lambda p: F.struct(p["table"].alias("table"), dots(p).alias("block"))))
    return reflowed(docs, "_parts")


def cells(docs: DataFrame) -> DataFrame:
    """(doc_id, table_id, row_no, col_no, cell, width): the cells of tables, separators left out, with
    the display width that each takes when written."""
    rows = find_tables(explode_lines(docs)).where("table_id is not null").where(~F.col("line").rlike(X.SEPARATOR))
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("line_no")))
    out = rows.select("doc_id", "table_id", "row_no", F.posexplode(X.split_cells(F.col("line"))).alias("col_no", "cell"))
    return out.withColumn("width", X.display_width(F.replace(F.col("cell"), F.lit("|"), F.lit("\\|"))))

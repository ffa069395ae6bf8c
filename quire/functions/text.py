"""Column expressions over single lines: white space, width, block kinds, fences, dot runs.

White space is Unicode White_Space throughout, as the class WS; Java's trim and \\s differ from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
WRAP_COLUMNS, BREAK_LENGTH, TAB = 80, 70, 4

# Patterns of Markdown constructs.
HEADING = r"^[ ]{0,3}#{1,6}(?:\p{IsWhite_Space}|\z)"
BULLET = r"^(\p{IsWhite_Space}*(?:[-*+]|\p{Nd}+[.)])\p{IsWhite_Space}+(?:\[\p{IsWhite_Space}*(?:[xX]|\p{IsWhite_Space})\p{IsWhite_Space}*\]\p{IsWhite_Space}*)?)(.*)"
QUOTE = r"^(\p{IsWhite_Space}*(?:>\p{IsWhite_Space}*)+)(.*)\z"
FOOTNOTE_DEFINITION = r"^(\p{IsWhite_Space}*)(\[\^[^\]]+\]:\p{IsWhite_Space}*)(.*)\z"
LINK_DEFINITION = r"^\p{IsWhite_Space}*\[[^\]]+\]:"
BARE_LABEL = r"^\p{IsWhite_Space}*\[[^\]]+\]:\p{IsWhite_Space}*\z"
LINK_TITLE = r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^)\\]|\\.)*\))\p{IsWhite_Space}*\z"
LINK_TARGET = r"^\p{IsWhite_Space}+(?:<[^>\p{IsWhite_Space}]+>|[^\p{IsWhite_Space}]+)(?:\p{IsWhite_Space}+" + LINK_TITLE[:-2] + r")?\z"
DIRECTIVE = r"(?i)^\p{IsWhite_Space}*<!--\p{IsWhite_Space}*markdownlint-(?:disable|enable|disable-line|disable-next-line)(?:\p{IsWhite_Space}+[A-Za-z0-9_\-/]+)*\p{IsWhite_Space}*-->\p{IsWhite_Space}*\z"
_KIND_MARK = r"^\p{IsWhite_Space}*[#>\[<*+\-\p{Nd}]"
SEPARATOR = r"^[\p{IsWhite_Space}|:-]+\z"
BREAK = r"^[ ]{0,3}((?:[ \t]*\*){3,}|(?:[ \t]*-){3,}|(?:[ \t]*_){3,})[ \t]*\z"
FENCE = r"^(\p{IsWhite_Space}*)(`{3,}|~{3,})([^\r\n]*)\z"

#: Characters of no width (marks and format characters) and of double width.
ZERO_WIDTH = r"[\p{Mn}\p{Me}\p{Cf}\x{1160}-\x{11FF}]"
WIDE = (
    r"[\x{1100}-\x{115F}\x{231A}\x{231B}\x{23E9}-\x{23EC}\x{23F0}\x{23F3}\x{25FD}\x{25FE}\x{2614}\x{2615}\x{2648}-\x{2653}"
    r"\x{267F}\x{2693}\x{26A1}\x{26AA}\x{26AB}\x{26BD}\x{26BE}\x{26C4}\x{26C5}\x{26CE}\x{26D4}\x{26EA}\x{26F2}\x{26F3}"
    r"\x{26F5}\x{26FA}\x{26FD}\x{2705}\x{270A}\x{270B}\x{2728}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2795}-\x{2797}"
    r"\x{27B0}\x{27BF}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{A000}-\x{A4CF}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}"
    r"\x{1F004}\x{1F0CF}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F200}-\x{1F320}\x{1F32D}-\x{1F335}\x{1F337}-\x{1F37C}\x{1F37E}-\x{1F393}"
    r"\x{1F3A0}-\x{1F3CA}\x{1F3CF}-\x{1F3D3}\x{1F3E0}-\x{1F3F0}\x{1F3F4}\x{1F3F8}-\x{1F43E}\x{1F440}\x{1F442}-\x{1F4FC}"
    r"\x{1F4FF}-\x{1F53D}\x{1F54B}-\x{1F54E}\x{1F550}-\x{1F567}\x{1F57A}\x{1F595}\x{1F596}\x{1F5A4}\x{1F5FB}-\x{1F64F}"
    r"\x{1F680}-\x{1F6C5}\x{1F6CC}\x{1F6D0}-\x{1F6D2}\x{1F6D5}-\x{1F6D7}\x{1F6DC}-\x{1F6DF}\x{1F6EB}\x{1F6EC}\x{1F6F4}-\x{1F6FC}"
    r"\x{1F7E0}-\x{1F7EB}\x{1F7F0}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{20000}-\x{3FFFD}]"
)


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+\\z", "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def is_blank(c: Column) -> Column:
    return c.rlike(f"^{WS}*\\z")


def leading_indent(c: Column) -> Column:
    """The white space that a line begins with."""
    return F.regexp_extract(c, f"^({WS}*)", 1)


def indent_columns(c: Column) -> Column:
    """Columns of the spaces and tabs that a line begins with, a tab being TAB of them."""
    indent = F.length(F.regexp_replace(F.regexp_extract(c, "^([ \\t]*)", 1), "\\t", " " * TAB))
    return F.when(c.isNull(), None).when(c.startswith(" ") | c.startswith("\t"), indent).otherwise(0)


def display_width(c: Column) -> Column:
    """Terminal columns of a text."""
    shown = F.regexp_replace(c, ZERO_WIDTH, "")
    return F.when(c.rlike("^[ -~]*\\z"), F.length(c)).otherwise(F.length(shown) + F.length(F.regexp_replace(shown, WIDE.replace("[", "[^", 1), "")))


def block_kind(c: Column) -> Column:
    """The kind of block that a line begins, null for plain text; needs an indent below four."""
    kinds = [
        (ltrim(c).startswith("#"), "heading"),
        (c.rlike(BULLET), "bullet"),
        (c.rlike(QUOTE), "blockquote"),
        (c.rlike(FOOTNOTE_DEFINITION), "footnote_definition"),
        (c.rlike(LINK_DEFINITION), "link_reference_definition"),
        (c.rlike(DIRECTIVE), "markdownlint_directive"),
        (ltrim(c).rlike("^[0-9]"), "digit_prefix"),
    ]
    found = F.lit(None).cast("string")
    for condition, name in reversed(kinds):
        found = F.when(condition, F.lit(name)).otherwise(found)
    # most lines begin with none of the marks
    return F.when(c.rlike(_KIND_MARK) & (indent_columns(c) < 4), found)


def quote_prefix(c: Column) -> Column:
    """struct(raw_prefix, depth, inner) of a block quote line, null for other lines."""
    raw = F.regexp_extract(c, QUOTE, 1)
    depth = F.length(raw) - F.length(F.replace(raw, F.lit(">"), F.lit("")))
    return F.when(c.rlike(QUOTE), F.struct(raw.alias("raw_prefix"), depth.alias("depth"), F.regexp_extract(c, QUOTE, 2).alias("inner")))


def is_fence(c: Column) -> Column:
    """struct(indent, marker, info) of a fence line, null for other lines; the indent spans quote marks."""
    quote = F.regexp_extract(c, QUOTE, 1)
    inner = F.when(c.rlike(QUOTE), F.regexp_extract(c, QUOTE, 2)).otherwise(c)
    part = lambda i: F.regexp_extract(inner, FENCE, i)
    return F.when(inner.rlike(FENCE), F.struct(F.concat(quote, part(1)).alias("indent"), part(2).alias("marker"), part(3).alias("info")))


def dots_to_ellipsis(c: Column) -> Column:
    """Every three dots as one ellipsis, from the left of each run."""
    return F.regexp_replace(c, r"\.{3}", "…")


def split_cells(c: Column) -> Column:
    """The cells of a table row: outer pipes go, escaped pipes stay in their cell without the escape."""
    bare = F.regexp_replace(trim(c), r"^\|+|\|+\z", "")
    parts = F.split(F.replace(bare, F.lit("\\|"), F.lit("\x1f")), r"\|", -1)
    return F.transform(parts, lambda x: F.replace(trim(x), F.lit("\x1f"), F.lit("|")))


def frontmatter_end(lines: Column) -> Column:
    """How many leading lines are YAML front matter: 0 unless the first is --- and a later one closes it."""
    closers = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: rtrim(x).isin("---", "..."))
    at = F.array_position(closers, True)
    return F.when((F.get(lines, F.lit(0)) == "---") & (at > 0), at + 1).otherwise(0).cast("int")

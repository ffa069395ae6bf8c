"""The whole normaliser as one lazy plan: passes are chosen when the plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, footnotes, html, inline, tables, wrap
from ..operators.lines import join_lines, split_lines


@dataclass(frozen=True)
class Options:
    """Passes beside the ones that always run (HTML tables, pipe tables)."""

    wrap: bool = False
    ellipsis: bool = False
    fences: bool = False
    footnotes: bool = False
    code_emphasis: bool = False
    headings: bool = False
    renumber: bool = False
    breaks: bool = False


def with_frontmatter(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """change applied to documents without their YAML front matter, which is put back unchanged. It
    travels with doc_id, so that the documents are read once and joined with nothing."""
    end = X.frontmatter_end(F.col("lines"))
    front = F.when(F.col("_end") > 0, F.slice("lines", F.lit(1), F.col("_end"))).alias("front")
    split = docs.select("doc_id", end.alias("_end"), "lines")
    body = split.select(F.struct("doc_id", front).alias("doc_id"), F.slice("lines", F.col("_end") + 1, F.size("lines")).alias("lines"))
    none = F.array().cast("array<string>")
    whole = F.concat(F.coalesce("doc_id.front", none), F.coalesce("lines", none)).alias("lines")
    return change(body).select("doc_id.doc_id", whole)


#: More partitions than any table has.
_ALL_PARTITIONS = 1 << 20


def _apart(docs: DataFrame) -> DataFrame:
    """The documents, in the partitions that they are in. Spark doesn't merge the expressions of one pass into those of
    the next over this; planning all of them as one would not end."""
    return docs.coalesce(_ALL_PARTITIONS)


def normalize_body(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """All chosen passes in their fixed order, without regard to front matter."""
    for wanted, change in (
        (options.fences, blocks.compress_fences),
        (options.fences, blocks.attach_orphan_specifiers),
        (True, html.convert_html_tables),
        (True, lambda d: tables.reflow_tables(d, options.ellipsis)),
        (options.headings, blocks.setext_headings),
        (options.code_emphasis, inline.fix_code_emphasis),
        (options.wrap, wrap.wrap),
        (options.ellipsis, inline.replace_ellipsis),
        (options.footnotes, footnotes.convert_footnotes),
        (options.renumber, blocks.renumber_lists),
        (options.breaks, blocks.format_breaks),
    ):
        if wanted:
            docs = _apart(change(docs))
    return docs


def normalize(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, lines) normalised, a document after the other: nothing is shuffled."""
    return with_frontmatter(docs.select("doc_id", "lines"), lambda d: normalize_body(d, options))


def normalize_texts(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, text) normalised; null texts count as empty."""
    lines = docs.select("doc_id", split_lines(F.coalesce(F.col("text"), F.lit(""))).alias("lines"))
    return normalize(lines, options).select("doc_id", join_lines(F.col("lines")).alias("text"))

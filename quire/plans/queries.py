"""Queries that render Markdown from the relational tables, run one operator and return its lines,
with DuckDB SQL that computes the same rows another way."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, footnotes, html, inline, lines, long_documents, spans, tables, wrap
from .pipeline import Options, normalize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes. What a task holds grows with its rows, not with the table.
ROWS_A_TASK = 50_000
#: Documents, where each row makes one of several lines.
DOCUMENTS_A_TASK = 5_000
#: Rows of the documents table, which are some thousand characters long.
TEXTS_A_TASK = 1_000


def _tasks(rows: DataFrame, each: int) -> int:
    """How many tasks the rows of a table are dealt to; a Parquet file's own counts tell it."""
    return max(1, math.ceil(rows.count() / each))


def _spread(rows: DataFrame, doc: str, each: int = ROWS_A_TASK) -> DataFrame:
    """Rows with doc_id, those of a document in one of as many partitions as the table's size asks for. A small file
    of very many rows would be one task otherwise, and partitions of a fixed number would grow with the table."""
    rows, n = rows.withColumn("doc_id", F.col(doc).cast("long")), _tasks(rows, each)
    return rows.repartition(n, "doc_id") if n > 1 else rows


def _docs(rows: DataFrame, doc: str, *order: str, line: Column | list) -> DataFrame:
    """Documents of rows: the lines of each row, in the given order."""
    each = F.array(*line) if isinstance(line, list) else line
    item = F.struct(*[F.col(o) for o in order], each.alias("_lines"))
    grouped = _spread(rows, doc).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    return grouped.select("doc_id", F.flatten(F.col("_all._lines")).alias("lines"))


def _two_parts(rows: DataFrame, order: str, line: Column, again: str, notes: list[Column]) -> DataFrame:
    """Documents of rows with doc_id, which meet once: a line for each in one order, and notes for each in another."""
    parts = [F.array_sort(F.collect_list(F.struct(F.col(o), F.array(*x).alias("_lines")))).alias(f"_{i}") for i, (o, x) in enumerate(((order, [line]), (again, notes)))]
    grouped = rows.groupBy("doc_id").agg(*parts)
    return grouped.select("doc_id", *[F.flatten(F.col(f"_{i}._lines")).alias(x) for i, x in enumerate(("lines", "notes"))])


def _head(docs: DataFrame, *first: str) -> DataFrame:
    """Documents with fixed lines before their own."""
    return docs.select("doc_id", F.concat(F.array(*map(F.lit, first)), "lines").alias("lines"))


def _out(docs: DataFrame) -> DataFrame:
    """A row for each line. Spark would compute lines again, to leave out those of none before they are exploded."""
    rows = docs.select("doc_id", F.posexplode_outer("lines").alias("line_no", "line")).where("line_no is not null")
    return rows.select("doc_id", F.col("line_no").cast("long"), "line")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _nations(spark: SparkSession, sf_dir: str, *line: Column) -> DataFrame:
    return _docs(_read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", line=list(line))


_NATION_TABLE = """
WITH t AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(n_nationkey AS VARCHAR) AS k, n_name AS n,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation),
w AS (SELECT doc_id, greatest(3, max(length(k))) AS a, greatest(4, max(length(n))) AS b FROM t GROUP BY doc_id)
SELECT doc_id, CAST(0 AS BIGINT) AS line_no, '| ' || rpad('key', CAST(a AS INT), ' ') || ' | ' || rpad('name', CAST(b AS INT), ' ') || ' |' AS line FROM w
UNION ALL SELECT doc_id, 1, '| ' || {first} || ' | ' || {second} || ' |' FROM w
UNION ALL SELECT doc_id, r + 1, '| ' || rpad(k, CAST(a AS INT), ' ') || ' | ' || rpad(n, CAST(b AS INT), ' ') || ' |' FROM t JOIN w USING (doc_id)
"""
_PLAIN_RULE = {"first": "repeat('-', a)", "second": "repeat('-', b)"}


@query(_NATION_TABLE.format(**_PLAIN_RULE))
def table_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("|  "), _s("n_nationkey"), F.lit("|"), F.col("n_name"), F.lit("   |"))
    return _out(tables.reflow_tables(_head(_nations(spark, sf_dir, row), "|key|name|", "|---|---|")))


@query(_NATION_TABLE.format(first="':' || repeat('-', a - 1)", second="CASE WHEN doc_id % 2 = 0 THEN repeat('-', b - 1) || ':' ELSE ':' || repeat('-', b - 2) || ':' END"))
def table_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), _s("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    docs = _nations(spark, sf_dir, row)
    rule = F.when(F.col("doc_id") % 2 == 0, "| :-- | --: |").otherwise("| :-- | :-: |")
    return _out(tables.reflow_tables(docs.select("doc_id", F.concat(F.array(F.lit("| key | name |"), rule), "lines").alias("lines"))))


@query("""
SELECT CAST(p_size AS BIGINT) AS doc_id, CAST(c AS INT) AS col_no, CAST(max(CASE c WHEN 0 THEN length(CAST(p_partkey AS VARCHAR)) WHEN 1 THEN length(p_name) ELSE length(p_brand) END) AS INT) AS width
FROM part CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY p_size, c
""")
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), _s("p_partkey"), F.lit(" | "), F.col("p_name"), F.lit("| "), F.col("p_brand"), F.lit(" |"))
    found = tables.cells(_docs(_read(spark, sf_dir, "part"), "p_size", "p_partkey", line=[row]))
    return found.groupBy("doc_id", "col_no").agg(F.max("width").alias("width"))


@query("""
WITH t AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(n_nationkey AS VARCHAR) AS k, n_name AS n,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, n_regionkey % 2 = 1 AND n_nationkey % 5 = 0 AS short FROM nation),
w AS (SELECT doc_id, max(length(k)) AS a, max(length(n)) AS b, bool_or(short) AND NOT bool_and(short) AS ragged FROM t GROUP BY doc_id)
SELECT doc_id, CAST(r AS BIGINT) AS line_no, CASE WHEN ragged THEN CASE WHEN short THEN '| ' || k || ' |' ELSE '| ' || k || ' | ' || n || ' |' END
  ELSE '| ' || rpad(k, CAST(a AS INT), ' ') || ' | ' || rpad(n, CAST(b AS INT), ' ') || ' |' END AS line FROM t JOIN w USING (doc_id)
""")
def table_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = (F.col("n_regionkey") % 2 == 1) & (F.col("n_nationkey") % 5 == 0)
    row = F.concat(F.lit("| "), _s("n_nationkey"), F.when(short, " |").otherwise(F.concat(F.lit(" | "), F.col("n_name"), F.lit(" |"))))
    return _out(tables.reflow_tables(_nations(spark, sf_dir, row)))


@query("""
WITH p AS (SELECT CAST(p_size AS BIGINT) AS doc_id, p_partkey AS k, p_brand AS n, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM part),
t AS (SELECT doc_id, CAST(k AS VARCHAR) AS k, n, r FROM p UNION ALL SELECT DISTINCT doc_id, 'key', 'name', 0 FROM p),
w AS (SELECT doc_id, max(length(k)) AS a, max(length(n)) AS b, max(r) AS m FROM t GROUP BY doc_id)
SELECT doc_id, CAST(r AS BIGINT) AS line_no, '| ' || rpad(k, CAST(a AS INT), ' ') || ' | ' || rpad(n, CAST(b AS INT), ' ') || ' |' AS line FROM t JOIN w USING (doc_id) WHERE m > 1
UNION ALL SELECT doc_id, r, CASE r WHEN 0 THEN '| key | name |    |' ELSE '| ' || k || ' | ' || n || ' |' END FROM t JOIN w USING (doc_id) WHERE m = 1
""")
def table_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _docs(_read(spark, sf_dir, "part"), "p_size", "p_partkey", line=[F.concat(F.lit("| "), _s("p_partkey"), F.lit(" | "), F.col("p_brand"), F.lit(" |"))])
    pairs = F.transform(
        F.filter("lines", lambda _, i: i % 2 == 0),
        lambda x, i: F.when(F.size("lines") > 2 * i + 1, F.concat(x, F.lit("  "), F.get(F.col("lines"), 2 * i + 1))).otherwise(x),
    )
    return _out(tables.reflow_tables(_head(parts.withColumn("lines", pairs), "| key | name |    |")))


@query("""
WITH t AS (SELECT CAST(p_size AS BIGINT) AS doc_id, CAST(p_partkey AS VARCHAR) AS k, replace(p_name, ' ', '\\|') AS n,
  row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS r FROM part),
w AS (SELECT doc_id, max(length(k)) AS a, max(length(n)) AS b FROM t GROUP BY doc_id)
SELECT doc_id, CAST(r AS BIGINT) AS line_no, '| ' || rpad(k, CAST(a AS INT), ' ') || ' | ' || rpad(n, CAST(b AS INT), ' ') || ' |' AS line FROM t JOIN w USING (doc_id)
""")
def table_escaped_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("|"), _s("p_partkey"), F.lit("|"), F.replace(F.col("p_name"), F.lit(" "), F.lit("\\|")), F.lit("|"))
    return _out(tables.reflow_tables(_docs(_read(spark, sf_dir, "part"), "p_size", "p_partkey", line=[row])))


@query("""
SELECT CAST(o_custkey AS BIGINT) AS doc_id, count(*) AS n_tables, CAST(sum(1 + o_orderkey % 2) AS BIGINT) AS n_lines FROM orders GROUP BY o_custkey
""")
def table_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("tail | "), F.col("o_orderstatus"))).otherwise(F.concat(F.lit("> note | "), F.col("o_orderstatus")))
    lines_ = [F.concat(F.lit("Order "), _s("o_orderkey")), F.concat(F.lit("| "), _s("o_orderkey"), F.lit(" |")), tail]
    rows = tables.find_tables(lines.explode_lines(_docs(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", line=lines_)))
    return rows.where("table_id is not null").groupBy("doc_id").agg(F.countDistinct("table_id").alias("n_tables"), F.count(F.lit(1)).alias("n_lines"))


@query("""
SELECT c_custkey AS doc_id, c_name || CASE WHEN c_custkey % 8 >= 3 THEN repeat('…', c_custkey % 8 // 3) || repeat('.', c_custkey % 8 % 3) ELSE repeat('.', c_custkey % 8) END AS line FROM customer
""")
def ellipsis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dots = F.repeat(F.lit("."), (F.col("c_custkey") % 8).cast("int"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), X.dots_to_ellipsis(F.concat("c_name", dots)).alias("line"))


@query("""
SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS line_no, CASE c_custkey % 4 WHEN 0 THEN 'See `a...b` of ' || c_name || '… now' WHEN 1 THEN 'See https://example.org/...' || c_name || ' and…'
  WHEN 2 THEN 'In ./src/.../' || c_name || ' wait….' ELSE '    code... ' || c_name END AS line FROM customer
""")
def ellipsis_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    line = (
        F.when(k == 0, F.concat(F.lit("See `a...b` of "), "c_name", F.lit("... now")))
        .when(k == 1, F.concat(F.lit("See https://example.org/..."), "c_name", F.lit(" and...")))
        .when(k == 2, F.concat(F.lit("In ./src/.../"), "c_name", F.lit(" wait....")))
        .otherwise(F.concat(F.lit("    code... "), "c_name"))
    )
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array(line).alias("lines"))
    return _out(inline.replace_ellipsis(docs))


@query("""
SELECT p_partkey AS doc_id, CAST(i AS BIGINT) AS line_no, CASE WHEN i = 0 THEN p_name WHEN p_partkey % 5 < 4 THEN repeat('_', 70) ELSE '-*-' END AS line
FROM part CROSS JOIN (VALUES (0), (1)) v(i)
""")
def thematic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    rule = F.when(k == 0, "---").when(k == 1, "* * *").when(k == 2, "_ __ _").when(k == 3, "\t***  ").otherwise("-*-")
    docs = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array("p_name", rule).alias("lines"))
    return _out(blocks.format_breaks(docs))


@query("""
WITH t AS (SELECT c_custkey AS doc_id, c_name AS n, CAST(c_custkey % 6 AS INT) AS k, CASE WHEN c_custkey % 2 = 0 THEN '=' ELSE '-' END AS m FROM customer)
SELECT doc_id, CAST(0 AS BIGINT) AS line_no, CASE WHEN k >= 3 THEN CASE m WHEN '=' THEN '> # ' ELSE '> ## ' END || n ELSE '> ' || n END AS line FROM t
UNION ALL SELECT doc_id, 1, CASE WHEN k >= 3 THEN '---' ELSE '> ' || repeat(m, k) END FROM t
UNION ALL SELECT doc_id, 2, '---' FROM t WHERE k < 3
""")
def setext_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("c_custkey") % 2 == 0, "=").otherwise("-")
    rule = F.concat(F.lit("> "), F.repeat(mark, (F.col("c_custkey") % 6).cast("int")))
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array(F.concat(F.lit("> "), "c_name"), rule, F.lit("---")).alias("lines"))
    return _out(blocks.setext_headings(docs))


@query("""
WITH t AS (SELECT l_orderkey AS doc_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
SELECT doc_id, CAST(r - 1 AS BIGINT) AS line_no, CAST(r AS VARCHAR) || '. part ' || CAST(l_partkey AS VARCHAR) AS line FROM t
""")
def list_renumber_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat((F.col("l_partkey") + 1).cast("string"), F.lit(". part "), _s("l_partkey"))
    rows = _read(spark, sf_dir, "lineitem")
    return _out(blocks.renumber_lists(_docs(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line=[item])))


@query("""
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey, g ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, reset
  FROM (SELECT *, o_orderkey % 4 = 0 AS reset, sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders)),
t AS (SELECT doc_id, r, CAST(0 AS BIGINT) AS s, '# order' AS line FROM o WHERE reset
  UNION ALL SELECT doc_id, r, 1, CAST(n AS VARCHAR) || '. order ' || CAST(k AS VARCHAR) FROM o
  UNION ALL SELECT doc_id, r, 2, '   1. status' FROM o UNION ALL SELECT doc_id, r, 3, '   2. date' FROM o)
SELECT CAST(doc_id AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, s) - 1 AS line_no, line FROM t
""")
def list_renumber_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.array(F.concat(F.lit("7. order "), _s("o_orderkey")), F.lit("   9. status"), F.lit("   9. date"))
    each = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.array(F.lit("# order")), item)).otherwise(item)
    rows = _read(spark, sf_dir, "orders")
    return _out(blocks.renumber_lists(_docs(rows, "o_custkey", "o_orderkey", line=each)))


_RANKED = """
WITH t AS (SELECT l_orderkey AS doc_id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY min(r)) AS n FROM t GROUP BY doc_id, p)
"""


@query(_RANKED + "SELECT doc_id, CAST(r - 1 AS BIGINT) AS line_no, 'Part[^' || CAST(n AS VARCHAR) || '] shipped' AS line FROM t JOIN f USING (doc_id, p)")
def footnote_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Part[^"), _s("l_partkey"), F.lit("] shipped"))
    rows = _read(spark, sf_dir, "lineitem")
    return _out(footnotes.convert_footnotes(_docs(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line=[line])))


@query(_RANKED + """SELECT doc_id, CAST(r - 1 AS BIGINT) AS line_no,
CASE WHEN p % 2 = 0 THEN 'Sold the part.[^' || CAST(n AS VARCHAR) || '] today' ELSE 'Sold the part[^' || CAST(n AS VARCHAR) || ']: today `a.1 `' END AS line FROM t JOIN f USING (doc_id, p)""")
def footnote_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _s("l_partkey")
    line = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Sold the part."), p, F.lit(" today"))).otherwise(F.concat(F.lit("Sold the part "), p, F.lit(": today `a.1 `")))
    rows = _read(spark, sf_dir, "lineitem")
    return _out(footnotes.convert_footnotes(_docs(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line=[line])))


@query(_RANKED + """, m AS (SELECT doc_id, max(r) AS m FROM t GROUP BY doc_id)
SELECT doc_id, CAST(r - 1 AS BIGINT) AS line_no, 'Part[^' || CAST(n AS VARCHAR) || ']' AS line FROM t JOIN f USING (doc_id, p)
UNION ALL SELECT doc_id, m, '' FROM m
UNION ALL SELECT doc_id, m + n, '[^' || CAST(n AS VARCHAR) || ']: note ' || CAST(p AS VARCHAR) FROM f JOIN m USING (doc_id)""")
def footnote_definition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    items = _spread(rows, "l_orderkey").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("_all"))
    refs = F.transform("_all.l_partkey", lambda p: F.concat(F.lit("Part[^"), p.cast("string"), F.lit("]")))
    notes = F.transform(F.array_sort(F.array_distinct("_all.l_partkey")), lambda p: F.concat(F.lit("[^"), p.cast("string"), F.lit("]: note "), p.cast("string")))
    return _out(footnotes.convert_footnotes(items.select("doc_id", F.concat(refs, F.array(F.lit("")), notes).alias("lines"))))


@query("""
WITH t AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
SELECT DISTINCT doc_id, CAST(i AS BIGINT) AS line_no, x AS line FROM t CROSS JOIN (VALUES (0, 'Intro'), (1, ''), (2, '## Footnotes'), (3, '')) v(i, x)
UNION ALL SELECT doc_id, r + 3, '[^' || CAST(r AS VARCHAR) || ']: about ' || n FROM t
""")
def footnote_trailing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _nations(spark, sf_dir, F.concat(F.lit("about "), "n_name"))
    docs = docs.select("doc_id", F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)).alias("lines"))
    return _out(footnotes.convert_footnotes(_head(docs, "Intro", "", "## Footnotes", "")))


@query("""
SELECT c_custkey AS doc_id, CAST(i AS BIGINT) AS line_no, CASE WHEN i = 1 THEN c_name WHEN c_custkey % 5 = 4 THEN CASE i WHEN 0 THEN '~~~~' WHEN 2 THEN '```' ELSE '~~~~' END
  WHEN i = 2 THEN 'end' WHEN i = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '```sql' ELSE '```' END ELSE '```' END AS line
FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) v(i)
""")
def fence_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mark = F.when(k % 5 == 4, "~~~~").otherwise(F.repeat(F.when(k % 3 == 0, "~").otherwise("`"), (3 + k % 4).cast("int")))
    info = F.when(k % 5 == 4, "").when(k % 2 == 0, "sql").otherwise("null")
    docs = _read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.array(F.concat(mark, info), F.col("c_name"), F.when(k % 5 == 4, "```").otherwise("end"), mark).alias("lines"))
    return _out(blocks.compress_fences(docs))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS BIGINT) AS line_no, CASE WHEN i = 1 THEN n_name WHEN i = 2 THEN '```' ELSE '```' || lower(n_name) END AS line
FROM nation CROSS JOIN (VALUES (0), (1), (2)) v(i) WHERE n_nationkey % 2 = 0
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(i AS BIGINT), CASE i WHEN 0 THEN 'text' WHEN 1 THEN n_name WHEN 3 THEN n_name ELSE '```' END
FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(i) WHERE n_nationkey % 2 = 1
""")
def fence_orphan_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, fence = F.col("n_name"), F.lit("```")
    each = F.when(F.col("n_nationkey") % 2 == 0, F.array(n, F.lit(""), fence, n, fence)).otherwise(F.array(F.lit("text"), n, fence, n, fence))
    docs = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), each.alias("lines"))
    return _out(blocks.attach_orphan_specifiers(docs))


@query("""
SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 0 END AS front FROM customer
""")
def frontmatter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    opener = F.when(k == 2, " ---").otherwise("---")
    closer = F.when(k == 0, "--- ").when(k == 1, "...").when(k == 3, " ---").otherwise("---")
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array(opener, F.concat(F.lit("title: "), "c_name"), closer, F.lit("body")).alias("lines"))
    return docs.select("doc_id", X.frontmatter_end(F.col("lines")).alias("front"))


_CUSTOMERS = """
WITH t AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)
SELECT doc_id, CAST(r // 4 AS BIGINT) AS line_no, {lead} || string_agg(c_name, ' ' ORDER BY r) AS line FROM t GROUP BY doc_id, r // 4
"""


@query(_CUSTOMERS.format(lead="''"))
def wrap_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(wrap.wrap(_docs(_read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", line=[F.col("c_name")])))


@query(_CUSTOMERS.format(lead="CASE WHEN r // 4 = 0 THEN '- ' ELSE '  ' END"))
def wrap_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(_read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", line=[F.col("c_name")])
    return _out(wrap.wrap(docs.select("doc_id", F.array(F.concat(F.lit("- "), F.array_join("lines", " "))).alias("lines"))))


@query()
def wrap_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents")
    docs = _spread(rows, "doc_id", TEXTS_A_TASK).select("doc_id", lines.split_lines(F.col("text")).alias("lines"))
    done = wrap.wrap(docs)
    widths = F.transform("lines", X.display_width)
    return done.select("doc_id", F.size("lines").alias("n_lines"), F.coalesce(F.array_max(widths), F.lit(0)).alias("widest"))


@query(_NATION_TABLE.format(**_PLAIN_RULE))
def html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), _s("n_nationkey"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>"))
    docs = _head(_nations(spark, sf_dir, row), "<table>", "<tr><th>key</th><th>name</th></tr>")
    docs = docs.select("doc_id", F.concat("lines", F.array(F.lit("</table>"))).alias("lines"))
    return _out(html.convert_html_tables(docs))


@query("""
SELECT c_custkey AS doc_id, k AS kind, CAST(n AS BIGINT) AS n FROM (SELECT c_custkey, 'code' AS k, 2 AS n FROM customer UNION ALL SELECT c_custkey, 'text', 2 FROM customer
UNION ALL SELECT c_custkey, 'newline', 3 FROM customer UNION ALL SELECT c_custkey, 'fence', 3 FROM customer)
""")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.concat(F.lit("a `"), "c_name", F.lit("` b ``x`y``s"))
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array(first, F.lit("```"), F.lit("`no`"), F.lit("```")).alias("lines"))
    return inline.tokenize(docs).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS line_no, CASE WHEN c_custkey % 2 = 0 THEN '**`' || c_name || '`v**' ELSE 'plain `' || c_name || '` text' END AS line FROM customer
""")
def code_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("`"), "c_name", F.lit("`**v**"))).otherwise(F.concat(F.lit("plain `"), "c_name", F.lit("` text")))
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array(line).alias("lines"))
    return _out(inline.fix_code_emphasis(docs))


@query("""
SELECT CASE c_custkey % 9 WHEN 0 THEN 'heading' WHEN 1 THEN 'bullet' WHEN 2 THEN 'blockquote' WHEN 3 THEN 'footnote_definition' WHEN 4 THEN 'link_reference_definition'
  WHEN 5 THEN 'markdownlint_directive' WHEN 6 THEN 'digit_prefix' ELSE 'none' END AS kind, count(*) AS n FROM customer GROUP BY 1
""")
def block_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = ["#", "- [x] ", " > ", "[^1]: ", "[a]: ", "<!-- markdownlint-disable MD013 -->", "2024 ", "    - ", "plain "]
    k = (F.col("c_custkey") % len(prefixes)).cast("int")
    line = F.when(k == 5, F.lit(prefixes[5])).otherwise(F.concat(F.get(F.array(*map(F.lit, prefixes)), k), F.col("c_name")))
    return _read(spark, sf_dir, "customer").groupBy(F.coalesce(X.block_kind(line), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(length(n_name) + CASE n_nationkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1 END AS INT) AS width FROM nation
""")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    tail = F.when(k == 0, "漢字").when(k == 1, "🙂").when(k == 2, "é").otherwise("é")
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), X.display_width(F.concat("n_name", tail)).cast("int").alias("width"))


@query("""
SELECT c_custkey AS doc_id, CAST(c_custkey % 4 AS INT) AS depth, c_name AS rest FROM customer
""")
def blockquote_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.repeat(F.lit("> "), (F.col("c_custkey") % 4).cast("int")), F.col("c_name"))
    quote = X.quote_prefix(line)
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.coalesce(quote["depth"], F.lit(0)).cast("int").alias("depth"), F.coalesce(quote["inner"], line).alias("rest")
    )


@query()
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_read(spark, sf_dir, "documents"), "doc_id", TEXTS_A_TASK).select("doc_id", lines.split_lines(F.col("text")).alias("lines"))
    every = Options(wrap=True, ellipsis=True, fences=True, footnotes=True, code_emphasis=True, headings=True, renumber=True, breaks=True)
    return _out(normalize(docs, every))


@query(_NATION_TABLE.format(first="':' || repeat('-', a - 1)", second="repeat('-', b - 1) || ':'"))
def table_promoted_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separator of the wrong width goes, and the second row, which looks like one, takes its place."""
    row = F.concat(F.lit("|"), _s("n_nationkey"), F.lit("| "), F.col("n_name"), F.lit(" |"))
    return _out(tables.reflow_tables(_head(_nations(spark, sf_dir, row), "|-|", "| key | name |", "|:--|--:|")))


@query("""
WITH t AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(n_nationkey AS VARCHAR) AS k, n_name AS n, n_nationkey % 2 = 1 AS odd,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation),
x AS (SELECT doc_id, r, 0 AS s, k, n FROM t UNION ALL SELECT doc_id, r, 1, '', 'more of ' || n FROM t WHERE odd UNION ALL SELECT DISTINCT doc_id, 0, 0, 'key', 'name' FROM t),
w AS (SELECT doc_id, CAST(greatest(3, max(length(k))) AS INT) AS a, CAST(greatest(3, max(length(n))) AS INT) AS b FROM x GROUP BY doc_id),
y AS (SELECT doc_id, r, s, '  | ' || rpad(k, a, ' ') || ' | ' || rpad(n, b, ' ') || ' |' AS line FROM x JOIN w USING (doc_id)
  UNION ALL SELECT doc_id, 0, 1, '  | ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |' FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, s) - 1 AS line_no, line FROM y
""")
def table_hidden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indented table with rows that begin with an empty cell, hidden rows and rows of empty cells."""
    name, first = F.col("n_name"), F.concat(F.lit("|"), _s("n_nationkey"), F.lit("|"), "n_name", F.lit("|"))
    odd = F.array(first, F.concat(F.lit("| | more of "), name, F.lit(" |")), F.concat(F.lit("\\- hidden | "), name))
    each = F.when(F.col("n_nationkey") % 2 == 1, odd).otherwise(F.array(first, F.lit("|  |  |")))
    docs = _docs(_read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", line=each)
    return _out(tables.reflow_tables(_head(docs, "  |key|name|", "|---|---|")))


@query("""
WITH t AS (SELECT CAST(p_size AS BIGINT) AS doc_id, CAST(p_partkey AS VARCHAR) || '…' AS k, p_name || '….' AS n, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS r FROM part),
w AS (SELECT doc_id, CAST(max(length(k)) AS INT) AS a, CAST(max(length(n)) AS INT) AS b FROM t GROUP BY doc_id)
SELECT doc_id, CAST(r AS BIGINT) AS line_no, '| ' || rpad(k, a, ' ') || ' | ' || rpad(n, b, ' ') || ' |' AS line FROM t JOIN w USING (doc_id)
""")
def table_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), _s("p_partkey"), F.lit("... | "), F.col("p_name"), F.lit(".... |"))
    return _out(tables.reflow_tables(_docs(_read(spark, sf_dir, "part"), "p_size", "p_partkey", line=[row]), ellipsis=True))


@query("""
WITH t AS (SELECT c_custkey AS doc_id, c_name AS n, c_custkey % 2 = 0 AS bold FROM customer)
SELECT doc_id, CAST(0 AS BIGINT) AS line_no, '  | ' || n || ' | a b |' AS line FROM t
UNION ALL SELECT doc_id, 1, '  | ' || repeat('-', CAST(length(n) AS INT)) || ' | --- |' FROM t WHERE bold
""")
def html_single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row is a header if all its cells are emphasised; white space collapses and scripts are no content."""
    bold = F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("i")
    name = F.concat(F.lit("<strong>"), "c_name", F.lit("</strong>"))
    lines_ = F.array(
        F.concat(F.lit("  <table><tr><td>"), name, F.lit("</td><td><"), bold, F.lit(">  a")), F.concat(F.lit("\tb</"), bold, F.lit("><script>x | y</script></td></tr></table>"))
    )
    docs = _spread(_read(spark, sf_dir, "customer"), "c_custkey", DOCUMENTS_A_TASK).select("doc_id", lines_.alias("lines"))
    return _out(html.convert_html_tables(docs))


@query("""
WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS n, CAST(greatest(5, length(n_name) + 3) AS INT) AS w, CAST(greatest(3, length(n_name)) AS INT) AS v FROM nation),
x AS (SELECT doc_id, i, '| ' || rpad(CASE i WHEN 0 THEN 'outer' WHEN 1 THEN repeat('-', w) WHEN 2 THEN 'in ' || n WHEN 3 THEN 'in' ELSE n END, w, ' ') || ' |' AS line
  FROM t CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(i)
  UNION ALL SELECT doc_id, i, '| ' || rpad(CASE i WHEN 5 THEN 'in' WHEN 6 THEN repeat('-', v) ELSE n END, v, ' ') || ' |' FROM t CROSS JOIN (VALUES (5), (6), (7)) v(i)
  UNION ALL SELECT doc_id, 8, 'after' FROM t)
SELECT doc_id, CAST(i AS BIGINT) AS line_no, line FROM x
""")
def html_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer table has the rows of the inner one, too; the inner one follows."""
    lines_ = F.array(
        F.lit("<table><tr><th>outer</th></tr>"), F.lit("<tr><td><table><tr><th>in </th></tr>"),
        F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td></tr></table></td></tr>")), F.lit("</table>"), F.lit("after"),
    )
    return _out(html.convert_html_tables(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), lines_.alias("lines"))))


@query("""
WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT DISTINCT doc_id, CAST(i AS BIGINT) AS line_no, x AS line FROM t CROSS JOIN (VALUES (0, '```'), (1, 'skip[^77]'), (2, '```')) v(i, x)
UNION ALL SELECT doc_id, 2 + r, 'Order[^' || CAST(r AS VARCHAR) || ']' FROM t
UNION ALL SELECT DISTINCT doc_id, 3 + n, '' FROM t
UNION ALL SELECT doc_id, 2 + n + 2 * r, '[^' || CAST(r AS VARCHAR) || ']: after[^1] and[^' || CAST(2 * n - r + 1 AS VARCHAR) || ']' FROM t
UNION ALL SELECT doc_id, 3 + n + 2 * r, '  more ' || CAST(k AS VARCHAR) FROM t
""")
def footnote_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in definitions count after those of the text, in the order in which they stand there;
    code is left out."""
    rows = _read(spark, sf_dir, "orders")
    orders = rows.withColumn("_down", -F.col("o_orderkey"))
    orders = _spread(orders, "o_custkey").withColumn("_first", F.min("o_orderkey").over(Window.partitionBy("doc_id")))
    key = _s("o_orderkey")
    ref = F.concat(F.lit("Order[^"), key, F.lit("]"))
    note = F.concat(F.lit("[^"), key, F.lit("]: after[^"), _s("_first"), F.lit("] and[^"), (F.col("o_orderkey") + 5 * 10**12).cast("string"), F.lit("]"))
    docs = _two_parts(orders, "o_orderkey", ref, "_down", [note, F.concat(F.lit("  more "), key)])
    code = F.array(F.lit("```"), F.lit("skip[^77]"), F.lit("```"))
    docs = docs.select("doc_id", F.concat(code, "lines", F.array(F.lit("")), "notes").alias("lines"))
    return _out(footnotes.convert_footnotes(docs))


@query("""
WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT doc_id, r - 1 AS line_no, 'Order[^' || CAST(r AS VARCHAR) || ']' AS line FROM t
UNION ALL SELECT DISTINCT doc_id, n, '' FROM t
UNION ALL SELECT doc_id, 2 * n - r + 1, '[^' || CAST(2 * n - r + 1 AS VARCHAR) || ']: note[^' || CAST(r AS VARCHAR) || ']' FROM t
""")
def footnote_list_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a trailing list get the numbers behind the references', from the last item up."""
    orders, key = _read(spark, sf_dir, "orders"), _s("o_orderkey")
    ref = F.concat(F.lit("Order[^"), key, F.lit("]"))
    item = F.concat((F.col("o_orderkey") + 5 * 10**12).cast("string"), F.lit(". note[^"), key, F.lit("]"))
    docs = _two_parts(_spread(orders, "o_custkey"), "o_orderkey", ref, "o_orderkey", [item])
    return _out(footnotes.convert_footnotes(docs.select("doc_id", F.concat("lines", F.array(F.lit("")), "notes").alias("lines"))))


@query("""
WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
x AS (SELECT doc_id, r AS a, 0 AS b, 'Order[^' || CAST(r AS VARCHAR) || ']' AS line FROM t UNION ALL SELECT DISTINCT doc_id, n + 1, 0, '' FROM t
  UNION ALL SELECT doc_id, n + 1 + r, 1, '[^' || CAST(r AS VARCHAR) || ']: note ' || CAST(k AS VARCHAR) FROM t
  UNION ALL SELECT doc_id, n + 1 + r, CASE WHEN r = 1 THEN 2 ELSE 0 END, '' FROM t WHERE r < n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS line_no, line FROM x
""")
def footnote_spaced_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty lines between definitions travel with the definition after them; that of the one which comes
    first goes behind it."""
    orders, key = _read(spark, sf_dir, "orders").withColumn("_down", -F.col("o_orderkey")), _s("o_orderkey")
    ref, note = F.concat(F.lit("Order[^"), key, F.lit("]")), F.concat(F.lit("[^"), key, F.lit("]: note "), key)
    docs = _two_parts(_spread(orders, "o_custkey"), "o_orderkey", ref, "_down", [F.lit(""), note])
    return _out(footnotes.convert_footnotes(docs.select("doc_id", F.concat("lines", "notes").alias("lines"))))


@query("""
SELECT c_custkey AS doc_id, CAST(i AS BIGINT) AS line_no, replace(x, '$', c_name) AS line FROM customer CROSS JOIN (VALUES (0, 'Intro to $'), (1, '| $ alone'), (2, '[$]:'), (3, '  http://x.example/$'),
  (4, '  "About $"'), (5, ''), (6, '[b]: http://y.example'), (7, '"$"'), (8, '# $'), (9, '    code $'), (10, '<!-- markdownlint-disable MD013 -->'), (11, 'tail $ goes on'), (12, '---')) v(i, x)
""")
def wrap_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, link definitions with targets and titles on lines of their own, headings, indented code,
    directives and rules stay; blank lines are emptied."""
    made = ["Intro to $", "| $ alone", "[$]:", "  http://x.example/$", '  "About $"', " \t ", "[b]: http://y.example", '"$"', "# $", "    code $", "<!-- markdownlint-disable MD013 -->", "tail $", "goes on", "---"]
    lines_ = F.array(*[F.replace(F.lit(x), F.lit("$"), F.col("c_name")) for x in made])
    return _out(wrap.wrap(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), lines_.alias("lines"))))


@query("""
SELECT c_custkey AS doc_id, CAST(i AS BIGINT) AS line_no, replace(x, '$', c_name) AS line
FROM customer CROSS JOIN (VALUES (0, '$  '), (1, 'after br  '), (2, 'odd \\'), (3, 'even \\\\ joined.[^1] then $'), (4, ''), (5, '> quoted  '), (6, '> more $')) v(i, x)
""")
def wrap_hard_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spaces, a br tag and an odd backslash end a line; no space stays before a footnote."""
    made = ["$  ", "after br<br/>", "odd \\", "even \\\\", "joined. [^1] then $", "", "> quoted<BR>", "> more $"]
    lines_ = F.array(*[F.replace(F.lit(x), F.lit("$"), F.col("c_name")) for x in made])
    return _out(wrap.wrap(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), lines_.alias("lines"))))


@query("""
WITH t AS (SELECT c_custkey AS doc_id, c_name AS n, c_custkey % 4 AS k, CAST(68 - length(c_name) AS INT) AS m FROM customer)
SELECT doc_id, CAST(0 AS BIGINT) AS line_no, repeat('x', CASE k WHEN 1 THEN 70 ELSE m + 3 * CAST(k = 2 AS INT) END) AS line FROM t WHERE k < 3
UNION ALL SELECT doc_id, CASE WHEN k < 3 THEN 1 ELSE 0 END,
  CASE k WHEN 0 THEN '[' || n || '](u v) [c](w) end' WHEN 1 THEN '4 May 2021 ' || n WHEN 2 THEN '(`' || n || ' in code`), end' ELSE '- run `' || n || ' x` then' END FROM t
UNION ALL SELECT doc_id, 1, 'next' FROM t WHERE k = 3
""")
def wrap_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of links, dates, code with the marks around it, and code that an item leaves open are kept together."""
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    pad = lambda m: F.repeat(F.lit("x"), (m - F.length(n)).cast("int"))
    each = (
        F.when(k == 0, F.array(F.concat(pad(68), F.lit(" ["), n, F.lit("](u v) [c](w) end"))))
        .when(k == 1, F.array(F.concat(F.repeat(F.lit("x"), F.lit(70)), F.lit(" 4 May"), F.lit(" 2021 "), n)))
        .when(k == 2, F.array(F.concat(pad(71), F.lit(" (`"), n, F.lit(" in code`), end"))))
        .otherwise(F.array(F.concat(F.lit("- run `"), n), F.lit("  x` then"), F.lit("next")))
    )
    return _out(wrap.wrap(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), each.alias("lines"))))


@query("""
SELECT c_custkey AS doc_id, CAST(d + 2 AS BIGINT) AS indent_chars, CAST(CASE WHEN d = 0 THEN 5 ELSE 0 END AS BIGINT) AS indent_cols,
  CASE WHEN d = 0 THEN ' ' || chr(9) ELSE repeat('> ', d) || ' ' || chr(9) END AS fence_indent, repeat('~', 3 + d) AS marker, ' ' || c_name AS info
FROM (SELECT *, CAST(c_custkey % 3 AS INT) AS d FROM customer)
""")
def fence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indents in characters and columns, and the parts of fence lines in quotes."""
    depth = (F.col("c_custkey") % 3).cast("int")
    line = F.concat(F.repeat(F.lit("> "), depth), F.lit(" \t"), F.repeat(F.lit("~"), depth + 3), F.lit(" "), F.col("c_name"))
    spaced = F.concat(F.lit("\u2003 "), F.repeat(F.lit(" "), depth), F.lit("x"))
    fence = X.is_fence(line)
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.length(X.leading_indent(spaced)).cast("long").alias("indent_chars"), X.indent_columns(line).cast("long").alias("indent_cols"),
        fence["indent"].alias("fence_indent"), fence["marker"].alias("marker"), fence["info"].alias("info"),
    )


@query("""
SELECT c_custkey AS doc_id, CAST(i AS BIGINT) AS line_no, replace(x, '$', upper(c_name)) AS line
FROM customer CROSS JOIN (VALUES (0, 'SEE `a b` OF $'), (1, '```sql'), (2, 'select `x`'), (3, '```'), (4, 'END'), (5, '')) v(i, x)
""")
def token_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = F.array(F.concat(F.lit("see `a b` of "), "c_name"), *map(F.lit, ("```sql", "select `x`", "```", "end", "")))
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), lines_.alias("lines"))
    return _out(inline.process_tokens(docs, lambda t: inline.original(t).upper() if t[0] == "text" else inline.original(t)))


@query("""
WITH t AS (SELECT c_custkey AS doc_id, c_name AS n, CAST(c_custkey AS VARCHAR) AS k FROM customer),
w AS (SELECT *, CAST(greatest(3, length(k)) AS INT) AS a, CAST(greatest(4, length(n)) AS INT) AS b, CAST(greatest(3, length(n)) AS INT) AS c FROM t),
x AS (SELECT doc_id, [ '---', 'title: ' || n || '...', '...', '# ' || n, '', '| ' || rpad('key', a, ' ') || ' | ' || rpad('name', b, ' ') || ' |', '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |',
  '| ' || rpad(k, a, ' ') || ' | ' || rpad(n, b, ' ') || ' |', '', '1. one…', '2. two', '   1. deep', '', '```', '9. code... ' || n, '```', '', 'Plain ' || n || ' goes on and on.[^1]', '', repeat('_', 70), '',
  '| ' || rpad('a', c, ' ') || ' |', '| ' || repeat('-', c) || ' |', '| ' || rpad(n, c, ' ') || ' |', '', '**`x` y**', '', '[^1]: note ' || n ] AS lines FROM w)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM x)
""")
def normalize_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes over documents that mix front matter, headings, tables, lists, code, notes, rules and HTML."""
    made = [
        "---", "title: $...", "...", "$", "=====", "", "|key|name|", "|-|-|", "|#|$|", "", "7. one...", "9. two", "   4. deep", "", "~~~~null", "9. code... $", "~~~~", "", "Plain $", "goes on and on.8", "", "---", "",
        "<table><tr><th>a</th></tr>", "<tr><td>$</td></tr></table>", "", "`x`** y**", "", "[^8]: note $",
    ]
    fill = lambda x: F.replace(F.replace(F.lit(x), F.lit("|#|"), F.concat(F.lit("|"), _s("c_custkey"), F.lit("|"))), F.lit("$"), F.col("c_name"))
    docs = _customers(spark, sf_dir, *map(fill, made))
    every = Options(wrap=True, ellipsis=True, fences=True, footnotes=True, code_emphasis=True, headings=True, renumber=True, breaks=True)
    return _out(normalize(docs, every))


def _customers(spark: SparkSession, sf_dir: str, *lines_: Column) -> DataFrame:
    """A document of some lines for each customer."""
    return _spread(_read(spark, sf_dir, "customer"), "c_custkey", DOCUMENTS_A_TASK).select("doc_id", F.array(*lines_).alias("lines"))


def _filled(*made: str) -> list[Column]:
    """Lines in which $ stands for the customer's name."""
    return [F.replace(F.lit(x), F.lit("$"), F.col("c_name")) for x in made]


@query(r"""
SELECT c_custkey AS doc_id, CAST(v.l AS BIGINT) AS line_no, CAST(v.pos AS BIGINT) AS pos, v.kind, replace(v.x, '$', c_name) AS text,
  CAST(length(replace(v.x, '$', c_name)) + CASE WHEN contains(v.x, '漢') THEN 1 ELSE 0 END AS BIGINT) AS width
FROM customer CROSS JOIN (VALUES (0, 0, 'plain', 'of'), (0, 1, 'whitespace', '  '), (0, 2, 'code', '(`a $`),'), (0, 3, 'whitespace', ' '), (0, 4, 'link', '[$ `c`](u(v)) ![i](w)'), (0, 5, 'whitespace', ' '),
  (0, 6, 'plain', '漢'), (1, 0, 'footnote', '$.[^1]'), (1, 1, 'whitespace', ' '), (1, 2, 'plain', 'pre-`$`'), (1, 3, 'whitespace', ' '), (1, 4, 'plain', '2 Feb 2020'), 
  (1, 5, 'plain', ' [^n]:'), (1, 6, 'whitespace', ' '), (1, 7, 'link', '"[a](b)"'), (6, 0, 'plain', '('), (6, 1, 'plain', '`$ and the rest.')) v(l, pos, kind, x)
""")
def inline_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that lines are broken between, with their kinds and widths."""
    made = ["of  (`a $`), [$ `c`](u(v)) ![i](w) 漢", "$. [^1] pre-`$` 2 Feb 2020 [^n]: \"[a](b)\"", "", "```", "`in` fence", "```", "(`$ and the rest."]
    return spans.inline_fragments(_customers(spark, sf_dir, *_filled(*made)))


@query(r"""
WITH t AS (SELECT c_custkey AS doc_id, c_custkey % 2 AS code, CAST(69 + c_custkey // 2 % 12 AS INT) AS m, repeat('x', CAST(69 + c_custkey // 2 % 12 AS INT)) AS a, c_name AS n FROM customer),
l AS (SELECT doc_id, code, a, CASE WHEN code = 1 THEN '`c`' ELSE 'cde' END AS c, CASE WHEN m <= 72 THEN 3 WHEN m <= 76 THEN 2 WHEN m = 77 THEN 1 + code ELSE 1 END AS k, n FROM t)
SELECT doc_id, CAST(0 AS BIGINT) AS line_no, array_to_string([a, 'ab', c, 'end'][1:k], ' ') AS line FROM l
UNION ALL SELECT doc_id, 1, array_to_string(list_concat([a, 'ab', c, 'end'][k + 1:], [n]), ' ') FROM l
""")
def wrap_last_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word may end in the last column before code, but not before another word."""
    pad = F.repeat(F.lit("x"), F.expr("int(69 + c_custkey div 2 % 12)"))
    third = F.when(F.col("c_custkey") % 2 == 1, "`c`").otherwise("cde")
    return _out(wrap.wrap(_customers(spark, sf_dir, F.concat_ws(" ", pad, F.lit("ab"), third, F.lit("end"), "c_name"))))


@query(r"""
SELECT c_custkey AS doc_id, CAST(v.pos AS BIGINT) AS pos, v.kind, replace(v.raw, '$', c_name) AS raw, v.fence, replace(v.code, '$', c_name) AS code
FROM customer CROSS JOIN (VALUES (0, 'code', '`$\` b`', '`', '$\` b'), (1, 'text', ' c', '', ''), (2, 'newline', chr(10), '', ''), (3, 'code', '`$\`', '`', '$\'), (4, 'text', ' b', '', ''), (5, 'newline', chr(10), '', ''),
  (6, 'text', '\` ', '', ''), (7, 'code', '`` a` $ ``s', '``', ' a` $ '), (8, 'text', ' ` d', '', ''), (9, 'newline', chr(10), '', ''), (10, 'code', '`a\`', '`', 'a\'), (11, 'text', ' $ ', '', ''), (12, 'code', '`b`', '`', 'b'), (13, 'text', ' c`', '', ''))
  v(pos, kind, raw, fence, code)
""")
def code_closing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of backticks that closes a span: an escaped one only if no other does, or another follows that one."""
    made = ["`$\\` b` c", "`$\\` b", "\\` `` a` $ ``s ` d", "`a\\` $ `b` c`"]
    return inline.tokenize(_customers(spark, sf_dir, *_filled(*made)))


@query(r"""
WITH t AS (SELECT c_custkey AS doc_id, c_name AS n, c_custkey % 6 AS k FROM customer)
SELECT doc_id, CAST(v.i AS BIGINT) AS line_no, replace(v.x, '$', n) AS line FROM t JOIN (VALUES
  (0, 0, '- [ ] Do `f(g($))` now'), (0, 1, 'then'), (1, 0, '- run `$` here and go on'), (2, 0, '> - use `a $` b'), (3, 0, '- one `a'), (3, 1, '  $`s end'), (4, 0, '1. code `C:\$\` ends'), (4, 1, 'next'),
  (5, 0, '- [x] `a'), (5, 1, '      $` is indented code')) v(k, i, x) USING (k)
""")
def wrap_open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose line leaves a code span open: joined tightly within parentheses or right behind the opening run, left as
    they are where a word part follows the closing one, and fitted otherwise, with what follows under the item."""
    made = (
        ["- [ ] Do `f(g(", "  $))` now", "then"],
        ["- run `", "  $", "  ` here and", "  go on"],
        ["> - use `a", "> $` b"],
        ["- one `a", "  $`s end"],
        ["1. code `C:\\$\\` ends", "next"],
        ["- [x] `a", "      $` is indented code"],
    )
    each = [F.when(F.col("c_custkey") % 6 == i, F.array(*_filled(*x))) for i, x in enumerate(made)]
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.coalesce(*each).alias("lines"))
    return _out(wrap.wrap(docs))


@query(r"""
SELECT c_custkey AS doc_id, CAST(v.i AS BIGINT) AS line_no, replace(v.x, '$', c_name) AS line FROM customer CROSS JOIN (VALUES
  (0, 'Some words about'), (1, '`the $ of a span that is wider than any'), (2, 'line may be, as it has $ in it twice`'), (3, 'and more.'), (4, ''), (5, '- an item `with a span that is as wide as that one and'), (6, '  goes on with $ here to its end`')) v(i, x)
""")
def wrap_wide_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code that is wider than a line keeps its own line ends, in paragraphs and items."""
    made = ["Some words about `the $ of a span that is wider than any", "line may be, as it has $ in it twice` and", "more.", "", "- an item `with a span that is as wide as that one and", "  goes on with $ here to its end`"]
    return _out(wrap.wrap(_customers(spark, sf_dir, *_filled(*made))))


@query(r"""
WITH t AS (SELECT c_custkey AS doc_id, c_name AS n, repeat('y', CAST(60 - length(c_name) AS INT)) AS pad FROM customer)
SELECT doc_id, CAST(0 AS BIGINT) AS line_no, n || ' ' || pad AS line FROM t
UNION ALL SELECT doc_id, 1, '[deep \] ' || n || '](a(b(c(d(e f))))) end' FROM t
UNION ALL SELECT doc_id, 2, '' FROM t
UNION ALL SELECT doc_id, 3, n || ' ' || pad FROM t
UNION ALL SELECT doc_id, 4, '[open](' || n || ' (and all the rest of it) that nothing closes, however long it may be or become' FROM t
""")
def wrap_nested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with parentheses five deep and escaped brackets stay whole; an open target takes the rest of its text."""
    pad = F.concat("c_name", F.lit(" "), F.repeat(F.lit("y"), (60 - F.length("c_name")).cast("int")))
    deep, open_ = _filled(" [deep \\] $](a(b(c(d(e f))))) end", " [open]($ (and all the rest of it) that nothing closes, however long it may be or become")
    return _out(wrap.wrap(_customers(spark, sf_dir, F.concat(pad, deep), F.lit(""), F.concat(pad, open_))))


@query(r"""
SELECT c_custkey AS doc_id, CAST(v.i AS BIGINT) AS line_no, replace(v.x, '$', c_name) AS line FROM customer CROSS JOIN (VALUES
  (0, '[$...](http://u/...) and… ![i...](./v/...)… so…'), (1, 'See <https://$/...>, (www.$...) or ../a/...b and/or…'), (2, '`$...` [a(`b...`)…](c…) \<x:…> …'), (3, '[$ [x...](y...)](z…) end…')) v(i, x)
""")
def ellipsis_literal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dots stay in code, links, autolinks, addresses and paths, which may overlap."""
    made = ["[$...](http://u/...) and... ![i...](./v/...)... so...", "See <https://$/...>, (www.$...) or ../a/...b and/or...", "`$...` [a(`b...`)...](c...) \\<x:...> ...", "[$ [x...](y...)](z...) end..."]
    return _out(inline.replace_ellipsis(_customers(spark, sf_dir, *_filled(*made))))


@query(r"""
SELECT c_custkey AS doc_id, CAST(v.i AS BIGINT) AS line_no, replace(replace(v.x, '$', c_name), '~', repeat('-', CAST(length(c_name) AS INT))) AS line FROM customer CROSS JOIN (VALUES
  (0, '| $ | key |'), (1, '| ~ | --- |'), (2, '| $ | b   |'), (3, 'between'), (4, '| ax  |'), (5, '| --- |'), (6, '| $ |'), (7, '| one $ | ztwo |'), (8, '| ----~ | ---- |'), (10, 'end')) v(i, x)
UNION ALL SELECT c_custkey, 9, '| ' || rpad('3', CAST(length(c_name) + 4 AS INT), ' ') || ' | 4    |' FROM customer
""")
def html_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without rows, groups and end tags, with text between their parts, tables begun within rows, and end tags that match nothing."""
    made = [
        "<table><td>$<td>key", "<tr>stray<th>$</th></div></tfoot><td>b</table>", "between", "<table><tr><td>a<b>x</b></td>y", "<table><tr><td>$</td></tr></table></table>",
        "<table><caption>no<tbody><tr><td>one $</p><th>z<b>two</tr></td>lost<i>too</i>", "</th><template><td>x</template><td>3<th>4<script>5</script></thead></table>", "end",
    ]
    return _out(html.convert_html_tables(_customers(spark, sf_dir, *_filled(*made))))


@query("""
SELECT c_custkey AS doc_id, CAST(v.i AS BIGINT) AS line_no, replace(v.x, '$', c_name) AS line FROM customer CROSS JOIN (VALUES
  (0, '# About $ in 3.4'), (1, ''), (2, '### Version 2.'), (3, 'A word of $.[^7] and more.[^2]'), (4, ''), (5, '1. one $'), (6, 'plain end')) v(i, x)
""")
def footnote_bail_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings keep their numbers, and references theirs where a document has list lines but no definitions."""
    made = ["# About $ in 3.4", "", "### Version 2.", "A word of $.[^7] and more.[^2]", "", "1. one $", "plain end"]
    return _out(footnotes.convert_footnotes(_customers(spark, sf_dir, *_filled(*made))))


@query("""
SELECT c_custkey AS doc_id, CAST(v.i AS BIGINT) AS line_no, replace(replace(v.x, '$', c_name), '~', repeat('-', CAST(length(c_name) AS INT))) AS line FROM customer CROSS JOIN (VALUES
  (0, '```'), (1, '| $ |'), (2, '| ~ |'), (3, '| two' || repeat(' ', 15) || ' |'), (4, '```')) v(i, x)
""")
def html_within_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in fenced code are converted as well where fences don't count."""
    docs = _customers(spark, sf_dir, *_filled("```", "<table><tr><td>$</td></tr><tr><td>two</td></tr></table>", "```"))
    return _out(html.convert_html_tables(docs, fences=False))


_DATES = ("4 May 2021", "(3rd Aug 1999),", "“March 31, 2024.”", "[12 december 1000]:", "pre-`x` of", "\"`a` `b`\"! at", "『[l](u)』、 at", "31 Foo 2021", "32 May 2021", "4 May 3000")
#: Columns of these, and characters of them that stay on the line when the last column is one too few.
_WIDTHS, _STAYS = (10, 15, 17, 19, 10, 13, 15, 11, 11, 10), (0, 0, 0, 1, 7, 10, 9, 6, 6, 5)


@query(
    "WITH t AS (SELECT c_custkey AS doc_id, c_name AS n, c_custkey % 10 + 1 AS k FROM customer), u AS (SELECT doc_id, n, ["
    + ", ".join("'" + x.replace("'", "''") + "'" for x in _DATES)
    + f"][k] AS d, repeat('x', 80 - {list(_WIDTHS)}[k]) AS pad, {list(_STAYS)}[k] AS c FROM t)"
    " SELECT doc_id, CAST(0 AS BIGINT) AS line_no, CASE WHEN c > 0 THEN pad || ' ' || left(d, c) ELSE pad END AS line FROM u"
    " UNION ALL SELECT doc_id, 1, ltrim(right(d, length(d) - c)) || ' ' || n FROM u"
)
def wrap_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates stay on one line, in brackets and quotation marks too, as do code and links with the marks around them and words
    that end in a hyphen before code; what only looks like a date is broken."""
    of = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % 10).cast("int"))
    pad = F.repeat(F.lit("x"), F.lit(80) - of(_WIDTHS))
    return _out(wrap.wrap(_customers(spark, sf_dir, F.concat_ws(" ", pad, of(_DATES), F.col("c_name")))))


#: Small, so that the table makes many chunks.
_SMALL_CHUNK = 2_048


def _one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as lines of one document: items of two indents, headings, quoted and plain fences, one open to the end."""
    k = F.col("o_orderkey")
    line = (
        F.when(k % 997 == 5, "````").when(k % 997 == 40, "```").when(k % 997 == 60, "````").when(k % 1499 == 3, "> ~~~").when(k % 1499 == 9, "> text").when(k % 511 == 0, "# Heading")
        .when(k % 7 == 0, F.concat(F.lit("9. order "), _s("o_orderkey"))).when(k % 3 == 0, F.concat(F.lit("   4. customer "), _s("o_custkey"))).otherwise("   and more")
    )
    return _read(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("doc_id"), k.cast("long").alias("line_no"), line.alias("line"))


@query("""
WITH RECURSIVE t AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_custkey AS c FROM orders),
l AS (SELECT k, CASE WHEN k % 997 = 5 THEN 4 WHEN k % 997 = 40 THEN 3 WHEN k % 997 = 60 THEN 4 WHEN k % 1499 = 3 THEN -3 ELSE 0 END AS f,
  CASE WHEN k % 997 IN (5, 40, 60) THEN 0 WHEN k % 1499 IN (3, 9) THEN 1 ELSE 0 END AS d FROM t),
e AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM (SELECT k, f, d, lag(d, 1, 0) OVER (ORDER BY k) AS b FROM l) WHERE f <> 0 OR d < b),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS k, 0 AS f, 0 AS d, 0 AS block, false AS was
  UNION ALL SELECT e.i, e.k,
    CASE WHEN (CASE WHEN r.f <> 0 AND e.d < r.d THEN 0 ELSE r.f END) = 0 THEN e.f WHEN e.f <> 0 AND e.d = r.d AND sign(e.f) = sign(r.f) AND abs(e.f) >= abs(r.f) THEN 0 ELSE r.f END,
    CASE WHEN (CASE WHEN r.f <> 0 AND e.d < r.d THEN 0 ELSE r.f END) = 0 THEN e.d ELSE r.d END,
    r.block + CASE WHEN (CASE WHEN r.f <> 0 AND e.d < r.d THEN 0 ELSE r.f END) = 0 AND e.f <> 0 THEN 1 ELSE 0 END, r.f <> 0 AND e.d >= r.d
  FROM r JOIN e ON e.i = r.i + 1)
SELECT CAST(l.k AS BIGINT) AS line_no, CASE WHEN r.k = l.k THEN r.was ELSE r.f <> 0 END AS was_in, l.f <> 0 AS marker, r.f <> 0 AND l.d >= r.d AS is_in, CAST(r.block AS INT) AS block
FROM l ASOF JOIN r ON r.k <= l.k
""")
def long_fence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fence states of a document with a line for each order, read in chunks."""
    return long_documents.fence_states(_one_document(spark, sf_dir), _SMALL_CHUNK).select("line_no", "was_in", "marker", "is_in", "block")


@query("""
WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_custkey AS c, o_orderkey % 10 AS m FROM orders),
g AS (SELECT *, sum(CASE WHEN k % 511 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS h, sum(CASE WHEN k % 511 = 0 OR m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS o FROM t),
n AS (SELECT *, sum(CASE WHEN m = 0 AND k % 511 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY h ORDER BY k) AS a, sum(CASE WHEN m = 4 OR m = 5 THEN CASE WHEN k % 511 <> 0 THEN 1 ELSE 0 END ELSE 0 END) OVER (PARTITION BY o ORDER BY k) AS b FROM g)
SELECT k AS line_no, CASE WHEN k % 511 = 0 THEN '# Heading' WHEN m = 0 THEN a || '. order ' || k WHEN m = 4 OR m = 5 THEN '   ' || b || '. customer ' || c ELSE '   and more' END AS line FROM n
""")
def long_list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List numbers of a document with a line for each order, counted in chunks."""
    k = F.col("o_orderkey")
    line = (
        F.when(k % 511 == 0, "# Heading").when(k % 10 == 0, F.concat(F.lit("9. order "), _s("o_orderkey")))
        .when((k % 10).isin(4, 5), F.concat(F.lit("   4. customer "), _s("o_custkey"))).otherwise("   and more")
    )
    rows = _read(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("doc_id"), k.cast("long").alias("line_no"), line.alias("line"))
    return long_documents.renumber(rows, _SMALL_CHUNK).select("line_no", "line")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
